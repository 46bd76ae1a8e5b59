"""A change as ordered steps: what to inspect, to edit and to verify, and the checks of changed files with their fallbacks.

found are the sections of a change's impact (section, place, id, path, line), pages of bounded size; projects are
(project_id, project_name, path, is_test); solutions are paths. Steps are few rows: phase, step (from 1 in each phase), kind, title, command,
targets (array) and truncated (how many more targets there are).

Edge cases: without found, projects or solutions the steps that need them are left out; paths that differ in case only count once; blank
paths are no targets; a project that stands twice is one target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import diagnostics, graph, overlay
from . import change, impact

# The steps that inspect and edit, in order: key, phase, title.
STEPS = (
    ("primary", "inspect", "Inspect primary change targets"),
    ("callers", "inspect", "Inspect direct callers"),
    ("relations", "inspect", "Inspect inheritance and override surfaces"),
    ("runtime", "inspect", "Inspect runtime wiring"),
    ("tests", "inspect", "Inspect related tests"),
    ("edit_primary", "edit", "Edit primary implementation files"),
    ("edit_dependent", "edit", "Adjust dependent code paths"),
    ("edit_runtime", "edit", "Reconcile runtime wiring if needed"),
)
#: The sections of a step in order: files of the second come after those of the first.
CALLERS, RELATIONS, RUNTIME, DEPENDENT = ("caller",), ("relation",), ("registration", "entrypoint"), ("caller", "relation")


def from_sections(found: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(at, path): each file of the sections once, ignoring case, by its first place."""
    order = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    rows = found.where(F.col("section").isin(*sections) & ~names.blank(F.col("path"))).select(F.struct(order.alias("section"), F.col("place").cast("long").alias("place")).alias("at"), "path")
    return graph.keep_first(rows, [names.fold_ci("path")], [F.col("at"), F.col("path")])


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows whose path isn't among the others, ignoring case."""
    keys = others.select(names.fold_ci("path").alias("other")).distinct()
    return rows.join(keys, names.fold_ci("path") == F.col("other"), "left_anti")


def first_paths(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy("at", "path").limit(max(1, k))


def test_projects(found: DataFrame, projects: DataFrame) -> DataFrame:
    """The test projects that hold a related test."""
    held = overlay.with_project(found.where("section = 'test'").select("path").where(~names.blank(F.col("path"))).distinct(), projects)
    return projects.where("is_test").join(held.select("project_id").distinct(), "project_id", "left_semi")


def inspect_and_edit(found: DataFrame, projects: DataFrame, k: int = 10) -> DataFrame:
    """The steps of the phases inspect and edit. Dependent files are those of no primary target, and wiring those of neither."""
    primary = first_paths(from_sections(change.primary_targets(found), ("target",)), k)
    dependent = without(from_sections(found, DEPENDENT), primary)
    at = F.struct(F.lit(0).alias("section"), F.row_number().over(W.partitionBy().orderBy(names.fold_ci("project_name"), "project_name")).cast("long").alias("place"))
    related = test_projects(found, projects).select("project_name").distinct().select(at.alias("at"), F.col("project_name").alias("path"))
    runtime = from_sections(found, RUNTIME)
    rows = {
        "primary": primary, "callers": from_sections(found, CALLERS), "relations": from_sections(found, RELATIONS), "runtime": runtime, "tests": related,
        "edit_primary": primary, "edit_dependent": dependent, "edit_runtime": without(without(runtime, primary), first_paths(dependent, k)),
    }
    every = None
    for i, (key, phase, title) in enumerate(STEPS):
        own = rows[key].select(F.lit(i).alias("n"), F.lit(phase).alias("phase"), F.lit(title).alias("title"), "at", "path")
        every = own if every is None else every.unionByName(own)
    top = graph.top_per_key(every, ["n", "phase", "title"], [F.col("at"), F.col("path")], k)
    listed = top.groupBy("n", "phase", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x.path).alias("targets"), F.max("truncated").alias("truncated"))
    step = F.row_number().over(W.partitionBy("phase").orderBy("n"))
    return listed.where("size(targets) > 0").select("phase", step.alias("step"), F.col("phase").alias("kind"), "title", F.lit("").alias("command"), "targets", "truncated")


def first_way(rows: DataFrame) -> DataFrame:
    """The rows of the smallest way that has any: a fallback counts only where nothing before it was found."""
    best = graph.free_name(rows, "_way")
    return rows.withColumn(best, F.min("way").over(W.partitionBy())).where(F.col("way") == F.col(best)).drop(best)


def _candidates(way: int, kind: str, rows: DataFrame, path: str = "path", name: str = "project_name") -> DataFrame:
    verb = "dotnet build " if kind == "build" else "dotnet test "
    return rows.where(~names.blank(F.col(path))).select(F.lit(way).alias("way"), F.lit(kind).alias("kind"), names.fold_ci(path).alias("at"), F.concat(F.lit(verb), path).alias("command"), F.col(name).alias("said"))


def _solution(solutions: DataFrame) -> DataFrame:
    """(path, project_name) of the first solution."""
    return solutions.where(~names.blank(F.col("path"))).orderBy(names.fold_ci("path"), "path").limit(1).select("path", F.col("path").alias("project_name"))


def _first_row(rows: DataFrame) -> DataFrame:
    return rows.orderBy(names.fold_ci("project_name"), "path").limit(1)


def commands(kind: str, impacted: DataFrame, related: DataFrame, projects: DataFrame, solutions: DataFrame, planned: bool) -> DataFrame:
    """(kind, at, command, said) of the first way that gives any.

    Builds: the solution; else the impacted projects that are no tests (a plan takes the first of them, else the first project of all).
    Tests: of a plan the related test projects, else the solution where it has tests; then the impacted test projects, then the solution.
    """
    solution = _solution(solutions)
    if kind == "build":
        own = impacted.where("not is_test")
        ways = [_candidates(0, kind, solution), _candidates(1, kind, _first_row(own) if planned else own)]
        if planned:
            ways.append(_candidates(2, kind, _first_row(projects)))
    else:
        tested = solution.join(projects.where("is_test").limit(1).select(F.lit(1).alias("any")), how="cross").select("path", "project_name")  # one row by one row
        ways = [_candidates(2, kind, impacted.where("is_test")), _candidates(3, kind, tested)]
        if planned:
            ways = [_candidates(0, kind, related), _candidates(1, kind, tested), *ways]
    rows = ways[0]
    for w in ways[1:]:
        rows = rows.unionByName(w)
    return graph.keep_first(first_way(rows), [F.col("command")], [F.col("at")]).select("kind", "at", "command", "said")


def command_steps(built: DataFrame, tested: DataFrame, focus: DataFrame, k: int, build_targets: DataFrame | None = None, titles: tuple[str, str] = ("Build changed projects", "Inspect focused diagnostics")) -> DataFrame:
    """The steps of the phase verify: builds, tests, then one step of the files (at, path) whose diagnostics to look at."""
    none = F.array().cast("array<string>")
    builds = graph.top_per_key(built, ["kind"], [F.col("at"), F.col("command")], k).select(F.lit(0).alias("n"), "place", "kind", F.lit(titles[0]).alias("title"), "command", none.alias("targets"))
    if build_targets is not None:
        builds = builds.drop("targets").join(build_targets.agg(F.array_sort(F.collect_set("project_name")).alias("targets")), how="cross")  # one row
    tests = graph.top_per_key(tested, ["kind"], [F.col("at"), F.col("command")], k).select(F.lit(1).alias("n"), "place", "kind", F.concat(F.lit("Run "), "said").alias("title"), "command", F.array(F.regexp_replace("command", "^dotnet test ", "")).alias("targets"))
    own = focus.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x.path).alias("targets")).where("size(targets) > 0")
    looked = own.select(F.lit(2).alias("n"), F.lit(1).alias("place"), F.lit("diagnostics").alias("kind"), F.lit(titles[1]).alias("title"), F.lit("").alias("command"), "targets")
    rows = builds.unionByName(tests).unionByName(looked)
    step = F.row_number().over(W.partitionBy().orderBy("n", "place"))
    return rows.select(F.lit("verify").alias("phase"), step.alias("step"), "kind", "title", "command", "targets", F.lit(0).cast("long").alias("truncated")).where(F.col("step") <= max(1, k))


def plan(found: DataFrame, nodes: DataFrame, projects: DataFrame, solutions: DataFrame, k: int = 10) -> DataFrame:
    """All steps of a change: inspect, edit and verify."""
    impacted = change.impacted_projects(found, nodes, projects)
    related = test_projects(found, projects)
    ranked = impact.ranked_files(found, k).select(F.struct((-F.col("score")).alias("score"), names.fold_ci("path").alias("key")).alias("at"), "path")
    built, tested = (commands(kind, impacted, related, projects, solutions, True) for kind in ("build", "test"))
    verify = command_steps(built, tested, ranked, k, impacted.where("not is_test"), ("Build the impacted workspace", "Inspect diagnostics on the highest-signal files"))
    return inspect_and_edit(found, projects, k).unionByName(verify).orderBy(F.array_position(F.array(F.lit("inspect"), F.lit("edit"), F.lit("verify")), F.col("phase")), "step")


def touched_projects(found: DataFrame | None, changed: DataFrame, nodes: DataFrame | None, projects: DataFrame) -> DataFrame:
    """Projects that the impact reaches or whose folder holds a changed file (path)."""
    held = overlay.with_project(changed.where(~names.blank(F.col("path"))).select("path").distinct(), projects).select("project_id")
    if found is not None:
        held = held.union(change.impacted_projects(found, nodes, projects).select("project_id"))
    return projects.join(held.distinct(), "project_id", "left_semi")


def focus(found: DataFrame | None, changed: DataFrame, k: int = 10) -> DataFrame:
    """(at, path): changed files first, then primary targets, then the files of the highest score; each once, k at most."""
    rows = changed.select(F.struct(F.lit(0).alias("way"), F.lit(0).cast("long").alias("place")).alias("at"), "path")
    if found is not None:
        rows = rows.unionByName(change.primary_targets(found).select(F.struct(F.lit(1).alias("way"), F.col("place").cast("long").alias("place")).alias("at"), "path"))
        rows = rows.unionByName(impact.ranked_files(found, k).select(F.struct(F.lit(2).alias("way"), (-F.col("score")).cast("long").alias("place")).alias("at"), "path"))
    first = graph.keep_first(rows.where(~names.blank(F.col("path"))), [names.fold_ci("path")], [F.col("at"), F.col("path")])
    return first_paths(first, k)


def verification(found: DataFrame | None, changed: DataFrame, nodes: DataFrame | None, projects: DataFrame, solutions: DataFrame, k: int = 10) -> DataFrame:
    """The steps that check changed files (path) and what an impact reaches; found may be missing, then the changed files decide alone."""
    impacted = touched_projects(found, changed, nodes, projects)
    related = projects.limit(0) if found is None else test_projects(found, projects)
    built, tested = (commands(kind, impacted, related, projects, solutions, found is not None) for kind in ("build", "test"))
    return command_steps(built, tested, focus(found, changed, k), k).orderBy("step")


def focused_diagnostics(found: DataFrame | None, changed: DataFrame, rows: DataFrame, minimum: str = "WARNING", k: int = 10) -> DataFrame:
    """Diagnostics of the minimum severity or above in the focus files; all of them where nothing is in focus."""
    own = focus(found, changed, k).select(names.fold_ci(paths.normalized(F.col("path"))).alias("key"))
    marked = diagnostics.filtered(rows, minimum)
    none = own.agg((F.count("*") == 0).alias("none")).scalar()
    return marked.where(none).unionByName(marked.where(~none).join(own, names.fold_ci(paths.normalized(F.col("uri"))) == F.col("key"), "left_semi"))
