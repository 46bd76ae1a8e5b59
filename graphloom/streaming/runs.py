"""The latest row of each key of a stream, in levelled runs: what a micro-batch writes grows with the batch, not with the state.

A batch becomes one run: the latest rows of its own keys, in a folder for each bucket of keys, sorted by key. ``FAN_IN`` runs of
a level are merged to one run of the next, so a row is written again once for each level and the levels grow with the logarithm of the number
of batches. The manifest of a batch names the live runs; it is written last. A batch that runs again after a failure overwrites its own
runs, and one whose manifest is whole does nothing, so replay gives the same state. Runs that neither of the last two manifests names
are deleted, so a reader that has opened one has the time of a batch to end.

Edge cases: an empty batch keeps the runs of the last one; null keys are a key; of equal versions the larger tie stays, of equal
rows one; a batch may hold older versions than the state does. Rows of one key never meet in one task before they are cut to one for each
task, so a hot key is no matter.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.diagnostics import latest
from ..operators.graph import free_name
from ..sources.snapshot import _files, _listed, _manifest, _numbers

FAN_IN, BUCKETS = 4, 16


def _write_run(rows: DataFrame, path: str, bucket: str, key: str) -> None:
    dealt = rows.hint("rebalance", bucket).sortWithinPartitions(bucket, key)
    dealt.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(bucket).parquet(path)


def _read_runs(spark: SparkSession, path: str, state: dict, runs: list[dict]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    if not runs:
        return spark.createDataFrame([], schema)
    out = None
    for r in runs:  # each run's own folder, so that its buckets are found as partitions
        own = spark.read.schema(schema).parquet(f"{path}/runs/{r['name']}")
        out = own if out is None else out.unionByName(own)
    return out


def apply_batch(batch: DataFrame, path: str, number: int, key: str, version: str, tie: str, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> None:
    """Adds the batch of that number to the state below path."""
    spark = batch.sparkSession
    if _manifest(spark, path, number) is not None:
        return
    before = next((m for m in (_manifest(spark, path, n) for n in sorted((n for n in _numbers(spark, path) if n < number), reverse=True)) if m is not None), None)
    bucket = before["bucket"] if before else free_name(batch, "bucket")
    buckets = before["buckets"] if before else buckets
    rows = latest(batch, key, version, tie).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    runs = list(before["runs"]) if before else []
    state = {"key": key, "version": version, "tie": tie, "bucket": bucket, "buckets": buckets, "schema": rows.schema.jsonValue()}
    if not batch.isEmpty():
        own = {"name": f"{number:08d}-0", "level": 0}
        _write_run(rows, f"{path}/runs/{own['name']}", bucket, key)
        runs.append(own)
    level = 0
    while Counter(r["level"] for r in runs)[level] >= max(2, fan_in):
        merged = {"name": f"{number:08d}-{level + 1}", "level": level + 1}
        _write_run(latest(_read_runs(spark, path, state, [r for r in runs if r["level"] == level]), key, version, tie), f"{path}/runs/{merged['name']}", bucket, key)
        runs = [r for r in runs if r["level"] != level] + [merged]
        level += 1
    fs, at = _files(spark, f"{path}/manifests/{number:08d}.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(state | {"runs": runs}).encode()))
    out.close()
    used = {r["name"] for r in runs} | {r["name"] for r in (before or {}).get("runs", [])}
    old = [f"runs/{name}" for name, _ in _listed(spark, f"{path}/runs") if name not in used]
    old += [f"manifests/{n:08d}.json" for n in sorted(_numbers(spark, path))[:-2]]
    for name in old:
        fs, at = _files(spark, f"{path}/{name}")
        fs.delete(at, True)


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, tie: str, buckets: int = BUCKETS, fan_in: int = FAN_IN, **trigger) -> StreamingQuery:
    """Keeps the state below path up to date with the stream; read_latest reads it."""

    def merge(batch: DataFrame, number: int) -> None:
        apply_batch(batch, path, number, key, version, tie, buckets, fan_in)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, path: str, keys: list | None = None) -> DataFrame | None:
    """The latest row of each key, or of the given keys only, whose buckets alone are read; None where no batch was written."""
    state = next((m for m in (_manifest(spark, path, n) for n in sorted(_numbers(spark, path), reverse=True)) if m is not None), None)
    if state is None:
        return None
    rows = _read_runs(spark, path, state, state["runs"])
    if keys is not None:
        kind = rows.schema[state["key"]].dataType
        found = F.lit(False)
        for k in keys:
            value = F.lit(k).cast(kind)
            found = found | ((F.col(state["bucket"]) == F.pmod(F.xxhash64(value), F.lit(state["buckets"])).cast("int")) & F.col(state["key"]).eqNullSafe(value))
        rows = rows.where(found)
    return latest(rows, state["key"], state["version"], state["tie"]).drop(state["bucket"])
