"""Interval labels of a forest: with them, what is above or below a node, how many, and how deep, are tests of ranges.

A node gets pre and post, the first and last number of its subtree, so that a node is in the subtree of another where its pre lies
between their pre and post. They come from pointer jumping: in round k every node knows its ancestor 2^k steps above, the steps to it, and the number of
nodes less than 2^k steps below; a join doubles the steps, so a chain of a million nodes takes 20 rounds. A second pass over the stored
jumps sums the offsets among siblings along the way to the root. Siblings are ordered by piece (a hash) and id; a node of very many children, or a forest
of very many roots, is numbered in pieces.

Edge cases: a node with several parents hangs below the smallest one, and parents tells how many there are; nodes on a cycle or below one have in_cycle
and null labels; rows with a null id are left out, repeated rows count once; a parent that is no id itself becomes a root; empty
tables give no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

#: Siblings that one task numbers.
PIECE_ROWS = 1_000_000
#: Seeds whose numbers become tests of the reader.
MOST_SEEDS = 1000


def _jumps(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jumps of each round (id, jump) and, after the last, id, depth, size and jump, which is null but on and below cycles."""
    most = tree.count()
    state = materialize(tree.select("id", F.col("parent_id").alias("jump"), F.col("parent_id").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), "jumps")
    rounds, steps = [], 1
    while steps <= most and not state.where("jump is not null").isEmpty():
        rounds.append(state.select("id", "jump"))
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        below = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("below"))
        moved = state.join(above, "jump", "left").join(below, "id", "left")
        state = materialize(moved.select("id", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "jumps")
        steps *= 2
    return rounds, state


def _offsets(sized: DataFrame) -> DataFrame:
    """id, offset: the numbers between a node's and its parent's, or before it of a root."""
    most = sized.groupBy("parent_id").count().agg(F.max("count")).first()[0] or 0
    pieces = -(-most // PIECE_ROWS) or 1
    rows = sized.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    sums = rows.groupBy("parent_id", "piece").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("parent_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    started = sums.select(F.col("parent_id").alias("_parent"), F.col("piece").alias("_piece"), before.alias("start"))
    within = F.coalesce(F.sum("size").over(W.partitionBy("parent_id", "piece").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("within", within).join(started, F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("piece") == F.col("_piece")))
    return placed.select("id", (F.col("start") + F.col("within") + F.col("parent_id").isNotNull().cast("long")).alias("offset"))


def label(links: DataFrame) -> DataFrame:
    """links (id, parent_id; null of a root) to id, parent_id, parents, depth (of a root 0), size (with itself), pre, post, in_cycle."""
    own = links.where("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.count_distinct("parent_id").alias("parents"))
    tops = links.where("id is not null and parent_id is not null").select(F.col("parent_id").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    tree = materialize(own.unionByName(tops.select("id", F.lit(None).cast(own.schema["parent_id"].dataType).alias("parent_id"), F.lit(0).cast("long").alias("parents"))), "tree")
    rounds, last = _jumps(tree)
    sized = materialize(tree.join(last, "id"), "sized")
    whole = sized.where("jump is null")
    state = materialize(_offsets(whole.select("id", "parent_id", "size")), "offsets")
    for jumps in rounds:
        above = state.select(F.col("id").alias("jump"), F.col("offset").alias("more"))
        moved = state.join(jumps, "id").join(above, "jump", "left")
        state = materialize(moved.select("id", (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "offsets")
    out = sized.join(state, "id", "left")
    fine = F.col("jump").isNull()
    columns = {"depth": F.col("depth"), "size": F.col("size"), "pre": F.col("offset"), "post": F.col("offset") + F.col("size") - 1}
    return materialize(out.select("id", "parent_id", "parents", *[F.when(fine, c).alias(n) for n, c in columns.items()], (~fine).alias("in_cycle")), "labels")


def _places(labels: DataFrame, seeds: DataFrame) -> list:
    """id, pre, post and depth of the seeds (id) that have labels, at most MOST_SEEDS."""
    found = labels.where("pre is not null").join(seeds.select("id").distinct(), "id", "left_semi").select("id", "pre", "post", "depth").limit(MOST_SEEDS + 1).collect()
    if len(found) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds; closure.ancestors and closure.reachable take any number")
    return found


def above(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_id, id, distance of what holds each of a few seeds, from its numbers alone."""
    parts = [F.when((F.col("pre") < p.pre) & (F.col("post") >= p.pre), F.struct(F.lit(p.id).alias("seed_id"), (F.lit(p.depth) - F.col("depth")).alias("distance"))) for p in _places(labels, seeds)]
    return _found(labels, parts)


def below(labels: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed_id, id, distance of the subtrees of a few seeds, without the seeds, down to max_depth steps."""
    parts = []
    for p in _places(labels, seeds):
        held = F.col("pre").between(p.pre + 1, p.post)
        held = held if max_depth is None else held & (F.col("depth") <= p.depth + max_depth)
        parts.append(F.when(held, F.struct(F.lit(p.id).alias("seed_id"), (F.col("depth") - F.lit(p.depth)).alias("distance"))))
    return _found(labels, parts)


def _found(labels: DataFrame, parts: list) -> DataFrame:
    kind = f"array<struct<seed_id: {dict(labels.dtypes)['id']}, distance: bigint>>"
    hits = F.array_compact(F.array(*parts)) if parts else F.array()
    return labels.select("id", F.explode(hits.cast(kind)).alias("hit")).select("hit.seed_id", "id", "hit.distance")
