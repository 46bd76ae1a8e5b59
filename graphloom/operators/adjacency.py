"""Edges stored in both directions, so that a lookup of a few ids reads the row groups that hold them and no others.

Each copy is dealt by ranges of (kind, end, other end) and sorted by them within its files, in a folder for each kind: the
statistics of a row group name a narrow range of ids, and a Bloom filter on the end answers for ids within the range that
aren't there. The other end is part of the range, so the edges of a hub go over several files. A lookup of up to ``MOST_SEEDS``
ids, which are counted first, becomes a filter that the Parquet reader gets; more seeds are semi-joined.

Edge cases: edges with a null end are left out, as no lookup finds them; repeated edges stay; no seeds or no edges give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

ENDS = {"source_id": "target_id", "target_id": "source_id"}
MOST_SEEDS = 1000
#: Parquet readers get a list of up to so many values as values, and a longer one as its range only.
LISTED = 10
GROUP_BYTES = 8 << 20


def store(edges: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """edges (kind, source_id, target_id) below path, once by each end."""
    for end, other in ENDS.items():
        rows = edges.select("kind", "source_id", "target_id").where(F.col(end).isNotNull() & F.col(other).isNotNull())
        dealt = rows.repartitionByRange("kind", end, other).sortWithinPartitions("kind", end, other)
        writer = dealt.write.partitionBy("kind").option(f"parquet.bloom.filter.enabled#{end}", "true").option("parquet.block.size", group_bytes)
        writer.parquet(f"{path}/{end}")


def edges_at(spark: SparkSession, path: str, seeds: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
    """kind, source_id, target_id of the edges of the kinds that end at a seed (id), or begin there."""
    end = "target_id" if incoming else "source_id"
    rows = spark.read.schema(schema.EDGES).parquet(f"{path}/{end}").where(F.col("kind").isin(kinds))
    wanted = seeds.select("id").where("id is not null").distinct()
    ids = sorted(r.id for r in wanted.limit(MOST_SEEDS + 1).collect())
    if len(ids) > MOST_SEEDS:
        return rows.join(wanted.withColumnRenamed("id", end), end, "left_semi").select("kind", "source_id", "target_id")
    lists = [F.col(end).isin(ids[i : i + LISTED]) for i in range(0, len(ids), LISTED)]
    return rows.where(reduce(lambda a, b: a | b, lists, F.lit(False))).select("kind", "source_id", "target_id")


def neighbors(path: str, nodes: DataFrame, seeds: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
    """The rows of graph.neighbors, from stored edges."""
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    own = edges_at(nodes.sparkSession, path, seeds, kinds, incoming)
    return own.select(F.col("kind").alias("edge_kind"), F.col(near).alias("seed_id"), F.col(far).alias("id")).join(nodes, "id")


class Stored:
    """Stored edges, in the place of a table of edges: the functions of operators.graph that begin at seeds look them up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def at(self, seeds: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
        return edges_at(self.spark, self.path, seeds, kinds, incoming)
