"""Change plans and their verification: ordered steps over the impact, and the diagnostics of the files in focus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import diagnostics, graph, overlay

# The phases of a plan in order: section, title.
STEPS = (
    ("target", "Inspect primary change targets"),
    ("caller", "Inspect direct callers"),
    ("relation", "Inspect inheritance and override surfaces"),
    ("registration", "Inspect runtime wiring"),
    ("test", "Inspect related tests"),
)


def prefer_production(targets: DataFrame) -> DataFrame:
    """Targets outside test folders, or all where there are no others."""
    test, others = graph.free_name(targets, "_test"), graph.free_name(targets, "_others")
    marked = targets.withColumn(test, F.coalesce(paths.test_folder(F.col("path")), F.lit(False)))
    return marked.withColumn(others, F.max((~F.col(test)).cast("int")).over(W.partitionBy())).where((F.col(others) == 0) | ~F.col(test)).drop(test, others)


def plan_steps(found: DataFrame, k: int = 10) -> DataFrame:
    """step (from 1, in the fixed order of phases), title, files (the first k, joined) of the sections that have files."""
    phase = F.when(F.col("section") == "entrypoint", "registration").otherwise(F.col("section"))
    titles = F.create_map(*[F.lit(x) for s, t in STEPS for x in (s, t)])
    ranks = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(STEPS) for x in (s, i)])
    rows = found.where(~names.blank(F.col("path"))).select(phase.alias("phase"), F.col("place").alias("own_place"), "path")
    first = graph.keep_first(rows, [F.col("phase"), names.fold_ci("path")], [F.col("own_place"), F.col("path")])
    top = graph.top_per_key(first, ["phase"], [F.col("own_place"), F.col("path")], k)
    files = top.groupBy("phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x.path), ",").alias("files"))
    order = F.element_at(ranks, F.col("phase"))
    return files.select((F.row_number().over(W.partitionBy().orderBy(order))).alias("step"), F.element_at(titles, F.col("phase")).alias("title"), "files")


def impacted_projects(found: DataFrame, nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of projects (project_id, project_name, path, ...) that the sections touch: those that own a found node, that hold the
    file of a test or entrypoint, or that an entrypoint stands for by its name."""
    placed = found.where("section in ('test', 'entrypoint')").select("path").where(~names.blank(F.col("path"))).distinct()
    ids = found.select("id").distinct()
    own = nodes.join(ids, "id", "left_semi")
    named = own.select("project_name").union(own.where("kind = 'Entrypoint'").select("display_name")).union(overlay.with_project(placed, projects).select("project_name"))
    keys = named.where(~names.blank(F.col("project_name"))).select(names.fold_ci("project_name").alias("key")).distinct()
    return projects.join(keys, names.fold_ci("project_name") == F.col("key"), "left_semi").orderBy(names.fold_ci("project_name"), "project_id")


def primary_targets(found: DataFrame) -> DataFrame:
    """The targets outside tests, or all of them where there are no others, in their order."""
    return prefer_production(found.where("section = 'target'")).orderBy("place")


def secondary_files(found: DataFrame) -> DataFrame:
    """Files of any section but those of the targets, ignoring case."""
    others = found.where("section <> 'target'").select("path").where(~names.blank(F.col("path"))).withColumn("key", names.fold_ci("path"))
    first = found.where("section = 'target'").select(names.fold_ci("path").alias("key")).distinct()
    return graph.keep_first(others.join(first, "key", "left_anti"), ["key"], [F.col("path")]).select("path")


def focus_files(changed: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """Changed files (path) first, then target files, then the rest; each once, k at most."""
    other = found.select("path", F.when(F.col("section") == "target", 1).otherwise(2).alias("rank"))
    rows = changed.select("path", F.lit(0).alias("rank")).unionByName(other).where(~names.blank(F.col("path")))
    return graph.keep_first(rows, [names.fold_ci("path")], [F.col("rank"), F.col("path")]).orderBy("rank", names.fold_ci("path")).limit(max(1, k))


def verify_change(found: DataFrame, changed: DataFrame, diagnostic_rows: DataFrame, minimum: str = "WARNING", k: int = 10) -> DataFrame:
    """Diagnostics of the minimum severity or above in the focus files."""
    return diagnostics.in_focus(diagnostics.filtered(diagnostic_rows, minimum), focus_files(changed, found, k))
