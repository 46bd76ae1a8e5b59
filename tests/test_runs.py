"""State of a stream in levelled runs: equal to the latest rows of all batches, and what a batch writes."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import runs

KIND = "uri string, version int, text string"


def batches(n, rows=40, seed=3):
    rng = random.Random(seed)
    out = [[(rng.choice(["hot", f"f{rng.randrange(60)}", None]), rng.randrange(1000), str(rng.randrange(9))) for _ in range(rows)] for _ in range(n)]
    out[2] = []
    return out


def latest(rows):
    best = {}
    for uri, version, text in rows:
        best[uri] = max(best.get(uri, (-1, "")), (version, text))
    return {(k, *v) for k, v in best.items()}


def state(spark, path, keys=None):
    return {tuple(r) for r in runs.read_latest(spark, path, keys).collect()}


def test_state_is_that_of_all_batches(spark, tmp_path):
    path, seen = f"file://{tmp_path}/state", []
    assert runs.read_latest(spark, path) is None
    for number, rows in enumerate(batches(11)):
        batch = spark.createDataFrame(rows, KIND)
        runs.apply_batch(batch, path, number, "uri", "version", "text", buckets=4, fan_in=3)
        seen += rows
        if number in (0, 2, 8, 10):
            assert state(spark, path) == latest(seen)
            assert len(runs.read_latest(spark, path).columns) == 3
    assert state(spark, path, ["hot", None, "nowhere"]) == {r for r in latest(seen) if r[0] in ("hot", None)}
    assert state(spark, path, []) == set()
    assert len(list((tmp_path / "state" / "runs").iterdir())) <= 8 and len(list((tmp_path / "state" / "manifests").glob("*.json"))) == 2


def test_replay(spark, tmp_path):
    path, own = f"file://{tmp_path}/state", batches(5, seed=8)
    for number, rows in enumerate(own[:4]):
        runs.apply_batch(spark.createDataFrame(rows, KIND), path, number, "uri", "version", "text", fan_in=2)
    want = state(spark, path)
    runs.apply_batch(spark.createDataFrame(own[3], KIND), path, 3, "uri", "version", "text", fan_in=2)  # its manifest is whole
    assert state(spark, path) == want
    (tmp_path / "state" / "manifests" / "00000003.json").write_text('{"runs": [')  # died within the manifest
    for crc in (tmp_path / "state" / "manifests").glob(".*.crc"):
        crc.unlink()
    assert state(spark, path) == latest(sum(own[:3], []))
    runs.apply_batch(spark.createDataFrame(own[3], KIND), path, 3, "uri", "version", "text", fan_in=2)
    assert state(spark, path) == want == latest(sum(own[:4], []))


def test_a_lookup_reads_its_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("uri"), F.col("id").cast("int").alias("version"), F.lit("x").alias("text"))
    runs.apply_batch(rows, path, 0, "uri", "version", "text", buckets=8)
    plan = runs.read_latest(spark, path, ["k7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert state(spark, path, ["k7"]) == {("k7", 7, "x")}


@pytest.mark.parametrize("held", [1000, 16000])
def test_a_batch_writes_what_it_brings(spark, tmp_path, held):
    """The rows that a small batch writes don't depend on how many keys the state holds."""
    path = f"file://{tmp_path}/state"
    key = F.concat(F.lit("k"), "id")
    runs.apply_batch(spark.range(held).select(key.alias("uri"), F.lit(0).alias("version"), F.lit("x").alias("text")), path, 0, "uri", "version", "text")
    for number in (1, 2):
        runs.apply_batch(spark.range(50).select(key.alias("uri"), F.lit(number).alias("version"), F.lit("y").alias("text")), path, number, "uri", "version", "text")
    written = {p.name: spark.read.parquet(f"file://{p}").count() for p in (tmp_path / "state" / "runs").iterdir()}
    assert written == {"00000000-0": held, "00000001-0": 50, "00000002-0": 50}
    assert runs.read_latest(spark, path).where("text = 'y' and version = 2").count() == 50


def test_a_stream(spark, tmp_path):
    for number, rows in enumerate(batches(4, seed=5)):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"file://{tmp_path}/state"
    runs.merge_stream(stream, path, f"{tmp_path}/checkpoint", "uri", "version", "text").awaitTermination(120)
    assert state(spark, path) == latest(sum(batches(4, seed=5), []))
