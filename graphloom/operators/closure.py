"""Transitive closures by rounds of joins. A round's frontier is written to the shared folder, so plans stay short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import fresh_path, materialize


#: Up to so many links go to every task whole, and a round then takes several steps.
SMALL_LINKS, STEPS = 100_000, 4


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (source_id, target_id), seeds (id): id and depth of all that is reached along edges, seeds at depth 0.

    Stops when a round reaches nothing new, so cycles end. Each round joins only what the last one reached with the edges.
    """
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "reached")
    links = materialize(edges.select("source_id", "target_id").distinct(), "links")
    small = links.count() <= SMALL_LINKS
    if small:
        links = F.broadcast(links)
    first = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    first.write.parquet(f"{path}/round=0")
    kind, depth, number = StructType([*first.schema.fields, StructField("round", IntegerType())]), 0, 0
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema(kind).parquet(path)
        frontier = seen.where((F.col("round") == number) & (F.col("depth") == depth)).select("id")
        steps = STEPS if small else 1
        steps = steps if max_depth is None else min(steps, max_depth - depth)
        new = None
        for i in range(1, steps + 1):
            frontier = frontier.join(links, frontier["id"] == links["source_id"]).select(F.col("target_id").alias("id")).distinct()
            own = frontier.withColumn("depth", F.lit(depth + i))
            new = own if new is None else new.unionByName(own)
        new = new.groupBy("id").agg(F.min("depth").alias("depth")).join(seen.select("id"), "id", "left_anti")
        number, depth = number + 1, depth + steps
        new.write.parquet(f"{path}/round={number}")
        if spark.read.schema(kind).parquet(path).where((F.col("round") == number) & (F.col("depth") == depth)).isEmpty():
            break
    return spark.read.schema(kind).parquet(path).select("id", "depth")


def stale_projects(changed: DataFrame, depends: DataFrame) -> DataFrame:
    """Changed projects (id) and all that depend on them, over depends (source_id depends on target_id)."""
    return reachable(depends.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), changed)


def ancestors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All containers above the seeds, scored by kind priority + 50."""
    from .. import schema

    up = edges.where("kind = 'contains'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    above = reachable(up, seeds).where("depth > 0").groupBy("id").agg(F.min("depth").alias("depth"))
    return above.join(nodes, "id").select("id", "depth", (schema.priority(F.col("kind"), schema.NODE_PRIORITY) + 50).alias("score"))


def changed_states(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Project states that are new or whose fingerprint differs."""
    before = previous.select("project_id", F.col("fingerprint").alias("before"))
    return current.join(before, "project_id", "left").where("before is null or before <> fingerprint").drop("before")


def merged_snapshot(previous: DataFrame, rebuilt: DataFrame, stale: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Rows of the previous snapshot whose owner isn't stale, and all rebuilt rows; a rebuilt row replaces one of the same keys."""
    from .graph import free_name, keep_first

    new = free_name(previous, "_new")
    kept = previous.join(stale.select(F.col("id").alias(owner)).distinct(), owner, "left_anti")
    rows = kept.withColumn(new, F.lit(0)).unionByName(rebuilt.withColumn(new, F.lit(1)))
    return keep_first(rows, keys, [F.desc(new), *[F.col(c) for c in sorted(previous.columns)]]).drop(new)
