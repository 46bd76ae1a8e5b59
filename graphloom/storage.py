"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, only local mode gets a folder of this machine; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    hadoop, deleted = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        deleted += at.getFileSystem(hadoop).delete(at, True)
    return deleted


def clear(spark: SparkSession) -> int:
    """Deletes what this application has written by fresh_path so far, and returns the number of folders. Results that were
    not yet written elsewhere are lost, so call it when the queries of a run are done."""
    return _delete(spark, _WRITTEN.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession):
    """What is written within is deleted at the end, but for the tables that are written by the function it gives, which is materialize."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(written), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(written[-1])
        return out

    try:
        yield keep
    finally:
        own = [p for p in written[before:] if p not in kept]
        written[before:] = kept
        _delete(spark, own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def little_disk(spark: SparkSession):
    """Shuffle files of each query that is made and run within are deleted when it ends, not when the driver collects its garbage, and
    tables are written in the smaller of the usual codecs."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
