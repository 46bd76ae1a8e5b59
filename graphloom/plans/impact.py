"""Change impact: what a change of a symbol or file reaches, by section, and the files to look at.

Sections are pages of bounded size (k rows); each carries the total it was cut from. File scores use the pages, not
what was cut, as a reader sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph
from ..operators.adjacency import Stored
from ..operators.name_scan import names_held
from ..storage import materialize

# The weight of a section in a file's score.
WEIGHTS = {"target": 100, "caller": 80, "relation": 70, "registration": 60, "entrypoint": 50, "test": 40}
SYMBOL_CANDIDATES = 12


def resolve_targets(nodes: DataFrame, edges: DataFrame | Stored, query: str | None = None, path: str | None = None, named: DataFrame | None = None) -> DataFrame:
    """Nodes that match the symbol query (best tier only), the document of the path and what it declares; the first way to match wins.

    named: those nodes that may hold the query, where an index of names knows.
    """
    parts = []
    if query:
        parts.append(graph.preferred(graph.ranked_symbols(nodes if named is None else named, query, SYMBOL_CANDIDATES)).select("id", F.lit(0).alias("way")))
    if path:
        own = nodes.where(names.fold_ci("file_path") == names.fold_text(path))
        parts += [own.where(~F.col("kind").isin("Document")).select("id", F.lit(1).alias("way")), own.where("kind = 'Document'").select("id", F.lit(2).alias("way"))]
    if not parts:
        raise ValueError("a symbol query or a file path is needed")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("id").agg(F.min("way").alias("way")).join(nodes, "id")


def page(rows: DataFrame, section: str, first: Column | int = 0) -> DataFrame:
    """rows of nodes as (section, first, id, path, line); first comes before the common order."""
    first = first if isinstance(first, Column) else F.lit(first)
    return rows.select(F.lit(section).alias("section"), first.cast("long").alias("first"), "id", F.col("file_path").alias("path"), "line")


def candidate_names(targets: DataFrame) -> DataFrame:
    """(name): display, metadata and documentation names of the targets and their trailing identifiers, in upper case."""
    payload = names.after_colon(F.col("documentation_id"))
    whole = F.array(*[F.substring_index(F.trim(c), "(", 1) for c in ("display_name", "metadata_name")], payload)
    own = targets.select(F.explode(whole).alias("name"))
    both = own.select(F.explode(F.array("name", names.trailing_identifier(F.col("name")))).alias("name"))
    return both.where(~names.blank(F.col("name"))).select(names.fold_ci("name").alias("name")).distinct()


def entrypoints(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Hosts of the targets' projects, and the entrypoints of any project in a target's file or that name a target."""
    found = nodes.where("kind = 'Entrypoint'")
    parts = names.unpack(F.col("documentation_id"))
    packed = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "entrypoint")
    host = found.where(packed & (F.get(parts, F.lit(1)) == "host_project")).join(targets.select("owning_project_id").where("owning_project_id is not null").distinct(), "owning_project_id", "left_semi")
    here = targets.where(~names.blank(F.col("file_path"))).select(names.fold_ci("file_path").alias("here")).distinct()
    placed = found.join(here, names.fold_ci("file_path") == F.col("here"), "left_semi")
    said = F.concat_ws("\n", "display_name", F.when(packed, F.get(parts, F.lit(2))), F.when(packed, F.get(parts, F.lit(3))))
    named = found.join(names_held(found, said, candidate_names(targets), ["id"]).select("id").distinct(), "id", "left_semi").select(*nodes.columns)
    return host.select(*nodes.columns).unionByName(placed).unionByName(named).dropDuplicates(["id"])


def sections(nodes: DataFrame, edges: DataFrame | Stored, query: str | None = None, path: str | None = None, k: int = 20, tests: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Targets, callers, relations, registrations, entrypoints and tests of a change, each at most k rows.

    tests: (path, score) of test files that concern the target, from the test map. named: as for resolve_targets.
    """
    targets = materialize(resolve_targets(nodes, edges, query, path, named), "targets")
    called = materialize(graph.call_seeds(nodes, edges, targets), "call-seeds")
    holders = materialize(graph.owning_types(nodes, edges, targets), "owners")
    callers = graph.neighbors(edges, nodes, called, ["calls"], incoming=True).select("id", "file_path", "line").distinct()
    related = graph.related_symbols(nodes, edges, holders).select("id", "file_path", "line").distinct()
    registered = graph.neighbors(edges, nodes, holders, ["registered_as", "consumed_by"], incoming=True).select("id", "file_path", "line").distinct()
    out = page(targets, "target", F.col("way"))
    for section, rows in (("caller", callers), ("relation", related), ("registration", registered), ("entrypoint", entrypoints(nodes, targets))):
        out = out.unionByName(page(rows, section))
    if tests is not None:
        rows = tests.select(F.concat(F.lit("test:"), "path").alias("id"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line"), "score")
        out = out.unionByName(page(rows, "test", -F.col("score")))
    # totals are partial counts and places are cut before the shuffle: a section of a hub's callers meets in no task
    best = graph.top_per_key(out, ["section"], [F.col("first"), *graph.node_order("path")], max(3, k))
    return best.where((F.col("place") <= max(1, k)) | (F.col("section") == "target")).select("section", "place", "id", "path", "line", "total")


def ranked_files(found: DataFrame, k: int = 20) -> DataFrame:
    """Files of the sections by summed weight: path, score, reasons."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("section"))
    rows = found.select("path", "section", weight.alias("weight"))
    return graph.file_scores(rows).orderBy(F.desc("score"), names.fold_ci("path"), "path").limit(max(1, k))


def change_impact(nodes: DataFrame, edges: DataFrame, query: str | None = None, path: str | None = None, k: int = 20, tests: DataFrame | None = None) -> DataFrame:
    return ranked_files(sections(nodes, edges, query, path, k, tests), k)
