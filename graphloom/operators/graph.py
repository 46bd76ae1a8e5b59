"""Joins and selections over nodes and edges. Edges without a node at the wanted end drop out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import names, paths, scores
from . import adjacency


def node_order(path: str = "file_path", line: str = "line") -> list[Column]:
    """Missing paths sort as empty, missing lines last; the id settles ties."""
    return [names.fold_ci(F.coalesce(path, F.lit(""))), F.coalesce(line, F.lit(schema.LAST_LINE)), F.col("id")]


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    n = free_name(df, "_n")
    return df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def free_name(df: DataFrame, name: str) -> str:
    """name, or one made of it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with place (from 1), total and truncated (rows of the key left out).

    Totals are partial sums and ranks are cut before the shuffle, so a key that holds most rows meets in no task.
    """
    totals = df.groupBy(*keys).agg(F.count("*").alias("total")).select(*[F.col(c).alias(f"_key_{c}") for c in keys], "total")
    first = df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= max(1, k))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return first.join(totals, same).select(*df.columns, "place", "total", F.greatest(F.col("total") - max(1, k), F.lit(0)).alias("truncated"))


def upsert_nodes(*batches: DataFrame) -> DataFrame:
    """Nodes by id; of several rows of an id the one of the last batch stays."""
    rows, number = None, free_name(batches[0], "_batch")
    for i, b in enumerate(batches):
        own = b.withColumn(number, F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    return keep_first(rows, ["id"], [F.desc(number), F.col("kind"), F.col("display_name")]).drop(number)


def edges_at(edges: DataFrame | adjacency.Stored, seeds: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
    """kind, source_id, target_id of the edges of the kinds that end at a seed (id), or begin there; edges are a table or stored."""
    if isinstance(edges, adjacency.Stored):
        return edges.at(seeds, kinds, incoming)
    end = "target_id" if incoming else "source_id"
    return edges.where(F.col("kind").isin(kinds)).join(seeds.select(F.col("id").alias(end)), end, "left_semi").select("kind", "source_id", "target_id")


def neighbors(edges: DataFrame | adjacency.Stored, nodes: DataFrame, seeds: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
    """seed_id, edge_kind and the node at the other end of each edge of the kinds at a seed (seeds: id)."""
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    own = edges_at(edges, seeds.select("id").distinct(), kinds, incoming).select(F.col("kind").alias("edge_kind"), F.col(near).alias("seed_id"), F.col(far).alias("id"))
    return own.select("seed_id", "edge_kind", "id").join(nodes, "id")


def edges_within(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends among the selected ids."""
    ids = selected.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("kind", "source_id", "target_id")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(names.fold_ci("kind").alias("kind_key")).agg(F.min("kind").alias("kind"), F.count("*").alias("n")).select("kind", "n")


def owner_counts(nodes: DataFrame) -> DataFrame:
    """Per owning project: documents and symbols, in one pass."""
    return nodes.where("owning_project_id is not null").groupBy("owning_project_id").agg(
        F.count_if(F.col("kind") == "Document").alias("documents"), F.count_if(~F.col("kind").isin(*schema.NOT_SYMBOLS)).alias("symbols")
    )


def ranked_symbols(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbol nodes that match the query, best first: score, tier, and the order project, path, line, id.

    Whatever matches holds the query in one of its names, so one test of them all leaves few rows to score.
    """
    held = names.fold_ci(F.concat_ws("\n", "documentation_id", "metadata_name", "display_name")).contains(names.fold_text(query))
    parts = (F.lit(query), F.col("documentation_id"), F.col("metadata_name"), F.col("display_name"))
    scored = nodes.where(~F.col("kind").isin(*schema.NOT_SYMBOLS)).where(held).withColumns({"score": scores.node_match_score(*parts), "tier": scores.identity_match(*parts)}).where("score > 0")
    return scored.orderBy(F.desc("score"), names.fold_ci(F.coalesce("project_name", F.lit(""))), *node_order()).limit(max(1, limit))


def preferred(matches: DataFrame) -> DataFrame:
    """Only the matches of the best tier that is there (identity, else name, else all)."""
    return matches.withColumn("_best", F.min("tier").over(W.partitionBy())).where("tier = _best or _best = 2").drop("_best")


def call_seeds(nodes: DataFrame, edges: DataFrame | adjacency.Stored, targets: DataFrame) -> DataFrame:
    """Ids whose callers count for the targets: a member and what it implements or overrides; a type's members, its bases, their members;
    a document's declared symbols."""
    ids = targets.select("id").distinct()
    kinds = targets if "kind" in targets.columns else nodes.select("id", "kind").join(ids, "id", "left_semi")
    members = kinds.where(F.col("kind").isin("Method", "Property", "Event", "Field")).select("id")
    types, documents = kinds.where("kind = 'Type'").select("id"), kinds.where("kind = 'Document'").select("id")

    def step(seeds: DataFrame, wanted: list[str]) -> DataFrame:
        return edges_at(edges, seeds, wanted, incoming=False).select(F.col("target_id").alias("id"))

    bases = step(types, ["implements", "inherits"])
    own_members = step(types, ["contains"])
    declared = edges_at(edges, documents, ["declared_in"], incoming=True).select(F.col("source_id").alias("id"))
    out = ids.union(step(members, ["implements", "overrides"])).union(own_members).union(step(own_members, ["implements", "overrides"])).union(bases).union(step(bases, ["contains"])).union(declared)
    return out.distinct()


def owning_types(nodes: DataFrame, edges: DataFrame | adjacency.Stored, seeds: DataFrame) -> DataFrame:
    """Seeds, the types that contain them, what they implement, inherit or override, and the types that contain that."""
    ids = seeds.select("id").distinct()
    types = nodes.where("kind = 'Type'").select(F.col("id").alias("owner"))
    targets = edges_at(edges, ids, ["implements", "inherits", "overrides"], incoming=False).select(F.col("target_id").alias("id"))
    reached = ids.union(targets)
    above = edges_at(edges, reached.distinct(), ["contains"], incoming=True).select(F.col("source_id").alias("owner"))
    owners = above.join(types, "owner", "left_semi").select(F.col("owner").alias("id"))
    return reached.union(owners).distinct()


def related_symbols(nodes: DataFrame, edges: DataFrame | adjacency.Stored, seeds: DataFrame) -> DataFrame:
    """Symbols that inherit, implement or override a seed; one row for each relation, documentation id, path and line."""
    found = neighbors(edges, nodes, seeds, ["inherits", "implements", "overrides"], incoming=True)
    keys = ["edge_kind", "documentation_id", "file_path", "line"]
    return keep_first(found, keys, [F.col("id")])


def project_neighbors(edges: DataFrame, nodes: DataFrame, project: DataFrame) -> DataFrame:
    """Projects that the seeds depend on or that depend on them, scored 850."""
    both = neighbors(edges, nodes, project, ["depends_on_project"], False).unionByName(neighbors(edges, nodes, project, ["depends_on_project"], True))
    return both.select("id", F.lit(850).alias("score")).distinct()


def max_score_reason(scored: DataFrame) -> DataFrame:
    """(id, score, reason, seq): the largest score of each id with its reason, the earliest on a tie."""
    return scored.groupBy("id").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", -F.col("seq"), F.col("reason"))).alias("reason"))


def file_scores(sections: DataFrame) -> DataFrame:
    """(path, section, weight) to path, score and its distinct sections: paths fold case, the first spelling stays."""
    rows = sections.where(~names.blank(F.col("path")))
    return (
        rows.groupBy(names.fold_ci("path").alias("key"))
        .agg(F.min("path").alias("path"), F.sum("weight").cast("long").alias("score"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("reasons"))
        .drop("key")
    )


def select_slice(scored: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The best nodes (at least 5) with graph ids n0, n1, ..., and the best edges among them.

    Limits are the feature: a slice is a picture of bounded size.
    """
    order = [F.desc("score"), F.desc("priority"), names.fold_ci(F.coalesce("project_name", F.lit(""))), names.fold_ci(F.coalesce("file_path", F.lit(""))), names.fold_ci("display_name"), F.col("id")]
    best = max_score_reason(scored)
    top = nodes.join(best, "id").withColumn("priority", schema.priority(F.col("kind"), schema.NODE_PRIORITY)).orderBy(*order).limit(max(5, max_nodes))
    numbered = top.withColumn("graph_id", F.concat(F.lit("n"), (F.row_number().over(W.partitionBy().orderBy(*order)) - 1).cast("string")))
    inside = edges_within(edges, numbered).withColumn("priority", schema.priority(F.col("kind"), schema.EDGE_PRIORITY))
    return numbered, inside.orderBy(F.desc("priority"), "kind", "source_id", "target_id").limit(max(5, max_edges))


def deepest_enclosing(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """positions (pos_id, path, pos) and ranges (range_id, path, first, last, rank): the shortest range that holds each position,
    ends included; ties by larger rank, then id. Positions in no range drop out.

    A range of up to 2^n places lies in at most two blocks of 2^n, and a position in one block for each n: the join is by path, n
    and block, so a position meets only ranges near it, also in a file that holds most of them.
    """
    size = F.col("last") - F.col("first") + 1
    level = F.greatest(F.ceil(F.log2(size.cast("double"))), F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), F.col("level")).cast("long")
    sized = ranges.where("first <= last").withColumn("level", level)
    blocks = F.array_distinct(F.array(F.floor(F.col("first") / step), F.floor(F.col("last") / step)))
    held = sized.withColumn("block", F.explode(blocks))
    levels = [r.level for r in sized.select("level").distinct().collect()]  # 64 at most
    if not levels:
        levels = [0]
    probes = positions.withColumn("level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))).withColumn("block", F.floor(F.col("pos") / step))
    within = probes.join(held, ["path", "level", "block"]).where("pos between first and last").drop("level", "block")
    return keep_first(within, ["pos_id"], [F.col("last") - F.col("first"), F.desc("rank"), F.col("range_id")])


#: Keys of more rows than this are split by time.
AS_OF_ROWS = 1_000_000


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """For each left row, the id and time of the last right row of its key at or before its time; null without one.

    One sorted pass over the union of both sides: no row meets more than its predecessor. Where a key holds very many
    rows, time is cut at quantiles, each piece is passed by itself, and the last right row of the pieces before it is carried in.
    """
    marked = left.withColumns({"_t": F.col(left_time), "_right": F.lit(1), "_found": F.lit(None).cast(f"struct<id:{dict(right.dtypes)[right_id]},t:{dict(right.dtypes)[right_time]}>")})
    other = right.select(F.col(by), F.col(right_time).alias("_t"), F.lit(0).alias("_right"), F.struct(F.col(right_id).alias("id"), F.col(right_time).alias("t")).alias("_found"))
    rows, order = marked.unionByName(other, allowMissingColumns=True), ["_t", "_right", "_found.id"]
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    pieces = -(-most // AS_OF_ROWS)
    if pieces < 2:
        last = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        seen = rows.withColumn("_seen", F.last("_found", ignorenulls=True).over(last)).where("_right = 1")
        return seen.select(*left.columns, F.col("_seen.id").alias("found_id"), F.col("_seen.t").alias("found_time"))
    number = F.col("_t").cast("double")
    cuts = rows.agg(F.percentile_approx(number, [i / pieces for i in range(1, pieces)])).first()[0]
    rows = rows.withColumn("_piece", sum([(number >= c).cast("int") for c in sorted(set(cuts))], F.lit(0)))
    ends = rows.where("_right = 0").groupBy(by, "_piece").agg(F.max_by("_found", F.struct("_t", F.col("_found.id"))).alias("_end"))
    every = rows.select(by, "_piece").distinct().join(ends, [by, "_piece"], "left")
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(W.partitionBy(by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    last = W.partitionBy(by, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("_own", F.last("_found", ignorenulls=True).over(last)).where("_right = 1").join(carried, [by, "_piece"], "left").withColumn("_seen", F.coalesce("_own", "_carried"))
    return seen.select(*left.columns, F.col("_seen.id").alias("found_id"), F.col("_seen.t").alias("found_time"))


def longest_prefix(items: DataFrame, owners: DataFrame) -> DataFrame:
    """items (item_id, path) with the owner (owner_id, directory) of the longest directory above the path; whole segments only."""
    above = items.select("item_id", "path", F.explode(paths.prefixes(F.col("path"))).alias("directory"))
    found = above.join(owners.select("owner_id", F.regexp_replace("directory", "/+$", "").alias("directory")), "directory")
    return keep_first(found, ["item_id"], [F.desc(F.char_length("directory")), F.col("owner_id")]).select("item_id", "path", "owner_id", "directory")
