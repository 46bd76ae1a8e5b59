"""Streams: latest row of each key, and windows with late rows."""

from pyspark.sql import functions as F

from graphloom.streaming import events


def test_latest_of_each_key(spark, tmp_path):
    kind = "uri string, version int, text string"
    spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], kind).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([("a", 2, "z"), ("b", 4, "old")], kind).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    events.keep_latest(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "uri", "version", "text").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/version=1")
    assert {(r.uri, r.text) for r in got.collect()} == {("a", "z"), ("b", "y")}


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "a", 4.0)], "t string, event_type string, value double")
    own = rows.withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.value) for r in events.window_counts(own, "5 minutes").collect()) == [(1, 4.0), (2, 3.0)]
    assert events.window_counts(own, "5 minutes", "1 minute").count() > 2
