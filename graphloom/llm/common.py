"""Helpers that the corpus operators share: shared-folder tables, text columns and label splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize, scratch  # noqa: F401  the other modules take them from here

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The white space of the contracts: `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as empty; further columns of the input are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves remainder 0 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of labelled rows that are not held out.

    Of more than max_rows labelled rows it takes the share max_rows / rows by a hash of the id, so that what a model
    is fitted on is bounded. Repeated labels of one id count once (the larger label wins); null labels are left out.
    The picked ids, at most about max_rows pairs of numbers, are broadcast, so no text is shuffled.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = picked.count()
    if n > max_rows:
        picked = picked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return id_and_text(docs).join(F.broadcast(picked), "doc_id")


def in_slices(batches, rows: int = 1000):
    """The Arrow batches in pieces of so many rows, so that what Python makes of one piece is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
