"""Names stored with postings of their trigrams, so that a search reads the few rows that may hold the query.

Three tables below a path: ``rows`` by id, with the number of their block of ``2 ** BLOCK_BITS`` neighbours, ``postings`` (gram, block) by
gram, both sorted with Bloom filters on id and gram, and ``grams`` with the number of blocks of each gram. Blocks keep the postings few:
neighbours share most grams, and what a task explodes it makes distinct before the shuffle. The text of a row is its names, folded, a line
for each; grams don't cross lines. A search looks up the counts of the query's grams, intersects the postings of the ``RAREST`` of them,
tests the rows of these blocks, and reads those that hold the query by their ids. All that holds the query has all its grams, so nothing is
lost; the caller scores the rows exactly. Where even the rarest gram lies in more than ``MOST_SEEDS`` blocks, all rows are tested.

Edge cases: queries of fewer than three characters, or with a line break, have no grams and get all rows; a query with a gram that no row
has gets none; null names are left out, rows without any name have no postings; rows with a null id can't be looked up and are kept in
every answer; an id of several rows may give them all. Folders stored before there were blocks have to be stored anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from .adjacency import GROUP_BYTES, LISTED, MOST_SEEDS
from .graph import free_name

SIZE, RAREST, BLOCK_BITS = 3, 3, 8


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (block, gram) of each batch of (block, folded text of lines). Characters are numbered in order of code, so that a
    block and three characters make one number."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        blocks, where = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
        points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)
        places = np.zeros(0x110000, np.int64)
        places[points] = 1
        known = np.flatnonzero(places)
        places[known] = np.arange(len(known))
        of = np.repeat(where, [len(t) + 1 for t in texts])
        number, line = places[points], points == ord("\n")
        whole = np.flatnonzero(~(line[:-2] | line[1:-1] | line[2:]))
        n = len(known)
        made = np.unique(((of[whole] * n + number[whole]) * n + number[whole + 1]) * n + number[whole + 2])
        spelled = known[np.stack([made // n**2 % n, made // n % n, made % n], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
        grams = [spelled[i : i + SIZE] for i in range(0, len(spelled), SIZE)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks[made // n**3], pa.int64()), pa.array(grams, pa.string())], ["block", "gram"])


def _said(columns: list[str]) -> Column:
    return names.fold_ci(F.concat_ws("\n", *columns))


def store(rows: DataFrame, path: str, columns: list[str], key: str = "id", group_bytes: int = GROUP_BYTES) -> None:
    """rows below path, to be searched by the texts in columns."""
    spark, gram, block = rows.sparkSession, free_name(rows, "gram"), free_name(rows, "block")

    def write(df: DataFrame, column: str, name: str) -> None:
        df.write.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.block.size", group_bytes).parquet(f"{path}/{name}")

    number = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)  # of places in the sorted rows; stored, so it is made once
    write(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn(block, number.alias(block, metadata={"texts": columns})), key, "rows")
    own = spark.read.parquet(f"{path}/rows").where(F.col(key).isNotNull()).select(F.col(block).alias("block"), F.make_valid_utf8(_said(columns)).alias("text"))
    own = own.mapInArrow(_block_grams, "block long, gram string").distinct().withColumnsRenamed({"block": block, "gram": gram})
    write(own.repartitionByRange(gram, block).sortWithinPartitions(gram, block), gram, "postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy(gram).agg(F.count("*").alias("n"))
    write(counted.repartitionByRange(gram).sortWithinPartitions(gram), gram, "grams")


def _among(column: str, values: list[str]) -> Column:
    """A test that the Parquet reader gets as values, however many they are."""
    return reduce(lambda a, b: a | b, [F.col(column).isin(values[i : i + LISTED]) for i in range(0, len(values), LISTED)], F.lit(False))


def may_hold(spark: SparkSession, path: str, query: str, key: str = "id") -> DataFrame:
    """The stored rows, but for most of those that don't hold the query in a name, whatever its case."""
    stored, folded = spark.read.parquet(f"{path}/rows"), names.fold_text(query)
    block, columns = next((f.name, f.metadata["texts"]) for f in stored.schema if "texts" in f.metadata)
    rows = stored.drop(block)
    if len(folded) < SIZE or "\n" in folded:
        return rows
    wanted = sorted({folded[i : i + SIZE] for i in range(len(folded) - SIZE + 1)})
    counts = spark.read.parquet(f"{path}/grams")
    gram = counts.columns[0]
    found = sorted((r["n"], r[gram]) for r in counts.where(_among(gram, wanted)).collect())  # at most one for each gram of the query
    null, holds = F.col(key).isNull(), _said(columns).contains(folded)
    if len(found) < len(wanted):
        return rows.where(null)
    if found[0][0] > MOST_SEEDS:
        return rows.where(holds | null)
    rarest = [g for _, g in found[:RAREST]]
    near = spark.read.parquet(f"{path}/postings").where(_among(gram, rarest)).groupBy(block).agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
    inside = _among(block, sorted(r[block] for r in near.collect())) & holds
    ids = stored.where(inside & ~null).select(key).distinct().limit(MOST_SEEDS + 1).collect()
    return rows.where(_among(key, sorted(r[key] for r in ids)) | null) if len(ids) <= MOST_SEEDS else stored.where(inside | null).drop(block)
