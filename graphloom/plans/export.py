"""Graph slices to export: around a symbol, of a project, or an overview of the solution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import names, paths
from ..operators import closure, graph
from ..storage import materialize

# The edge kinds of a slice where none are named, and the kinds that have containers added.
EDGE_KINDS = ("contains", "depends_on_project", "inherits", "implements", "overrides", "calls", "registered_as", "consumed_by")
HELD = ("Type", "Method", "Property", "Event")
FOCUS_CANDIDATES = 8


def edge_kinds(wanted=None) -> list[str]:
    """The wanted kinds without blanks, each once ignoring case; one that isn't known, in this spelling, is an error."""
    out: dict[str, str] = {}
    for kind in wanted or EDGE_KINDS:
        if kind and kind.strip():
            out.setdefault(kind.strip().lower(), kind.strip())
    for kind in out.values():
        if kind not in schema.EDGE_PRIORITY:
            raise ValueError(f"unknown edge kind {kind!r}; the kinds are {', '.join(schema.EDGE_PRIORITY)}")
    return list(out.values())


def node_kinds(types: bool = False, members: bool = False, documents: bool = False, registrations: bool = False, entrypoints: bool = False, seeds: bool = False) -> list[str]:
    """The node kinds that the flags let in; seeds lets in all symbols."""
    out = ["Solution", "Project"]
    if types or members or seeds:
        out += ["Namespace", "Type"]
    if members or seeds:
        out += ["Method", "Property", "Event", "Field"]
    return out + [kind for kind, on in (("Document", documents), ("DiRegistration", registrations), ("Entrypoint", entrypoints)) if on]


def matching_projects(nodes: DataFrame, text: str) -> DataFrame:
    """Project nodes whose name, path or assembly (metadata name) holds the text; only exact ones where there are any."""
    q = F.lit(text.strip())
    held = [names.contains_ci(F.col(c), q) for c in ("display_name", "file_path", "metadata_name")]
    same = [names.equals_ci(c, q) for c in (F.col("display_name"), F.col("metadata_name"), paths.stem(F.col("file_path")))]
    any_of = lambda tests: F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests])
    found = nodes.where("kind = 'Project'").where(any_of(held)).withColumn("exact", any_of(same))
    best = found.agg(F.max("exact").alias("some"))
    return found.join(F.broadcast(best), ~F.col("some") | F.col("exact")).select(*nodes.columns)  # best is one row


def _scored(rows: DataFrame, score: Column | int, reason: Column | str, seq: int) -> DataFrame:
    score, reason = (c if isinstance(c, Column) else F.lit(c) for c in (score, reason))
    return rows.select("id", score.cast("int").alias("score"), reason.alias("reason"), F.lit(seq).alias("seq"))


def host_entrypoints(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """Entrypoints that stand for the project itself, of the projects (project_name)."""
    part = names.unpack(F.col("documentation_id"))
    own = projects.select(names.fold_ci("project_name").alias("key")).where("key is not null").distinct()
    hosts = nodes.where("kind = 'Entrypoint'").where((F.size(part) == 4) & (F.get(part, F.lit(0)) == "entrypoint") & (names.fold_ci(F.get(part, F.lit(1))) == "HOST_PROJECT"))
    return hosts.join(own, names.fold_ci("project_name") == F.col("key"), "left_semi")


def _with_containers(nodes: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    return closure.ancestors(nodes, edges, rows).select("id", "score", F.lit("container").alias("reason"), F.lit(5).alias("seq"))


def focus_slice(nodes: DataFrame, edges: DataFrame, query: str, kinds: list[str], gate: list[str]) -> DataFrame:
    """The symbols that match (1000), their neighbours over the edge kinds in either direction (800), the host entrypoints of
    their projects (400), and the containers of all of these symbols."""
    focus = materialize(graph.preferred(graph.ranked_symbols(nodes, query, FOCUS_CANDIDATES)).select(*nodes.columns), "focus")
    out = _scored(focus, 1000, "focus", 0)
    near = None
    for incoming in (False, True):
        own = graph.neighbors(edges, nodes.where(F.col("kind").isin(gate)), focus, kinds, incoming).select("id", "edge_kind")
        near = own if near is None else near.unionByName(own)
    near = materialize(near, "near")
    out = out.unionByName(_scored(near, 800, F.col("edge_kind"), 1))
    out = out.unionByName(_scored(host_entrypoints(nodes, focus), 400, "host_project", 2))
    return out.unionByName(_with_containers(nodes, edges, focus.select("id").union(near.select("id"))))


def project_slice(nodes: DataFrame, edges: DataFrame, text: str, gate: list[str]) -> DataFrame:
    """The projects that match (1000), those that they depend on or that depend on them (850), what they own by kind, with containers."""
    own = materialize(matching_projects(nodes, text), "projects")
    owned = nodes.where(F.col("kind").isin(gate)).join(own.select(F.col("id").alias("owning_project_id")), "owning_project_id", "left_semi")
    out = _scored(own, 1000, "project", 0).unionByName(_scored(graph.project_neighbors(edges, nodes, own), 850, "project-dependency", 1))
    out = out.unionByName(_scored(owned, schema.priority(F.col("kind"), schema.NODE_PRIORITY), "project-slice", 2))
    return out.unionByName(_with_containers(nodes, edges, owned.where(F.col("kind").isin(*HELD))))


def overview_slice(nodes: DataFrame, gate: list[str]) -> DataFrame:
    """The solution (1000), its projects (900), and nodes of the gate's kinds by their priority."""
    out = _scored(nodes.where("kind = 'Solution'"), 1000, "solution", 0).unionByName(_scored(nodes.where("kind = 'Project'"), 900, "project", 1))
    return out.unionByName(_scored(nodes.where(F.col("kind").isin(gate)), schema.priority(F.col("kind"), schema.NODE_PRIORITY), "overview", 2))


def select(
    nodes: DataFrame, edges: DataFrame, focus: str | None = None, project: str | None = None, kinds=None, max_nodes: int = 80, max_edges: int = 160,
    types: bool = True, members: bool = False, documents: bool = False, registrations: bool = True, entrypoints: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """The best nodes and edges of the slice, and warnings: a focus or project that matches nothing falls through to the next form."""
    kinds, warnings, scored = edge_kinds(kinds), [], None
    flags = {"documents": documents, "registrations": registrations, "entrypoints": entrypoints}
    if focus and focus.strip():
        scored = materialize(focus_slice(nodes, edges, focus, kinds, node_kinds(types, members, seeds=True, **flags)), "slice")
        if scored.isEmpty():
            warnings.append(f"No graph symbol matched {focus!r}.")
            scored = None
    if scored is None and project and project.strip():
        scored = materialize(project_slice(nodes, edges, project, node_kinds(types, members, **flags)), "slice")
        if scored.isEmpty():
            warnings.append(f"No graph project matched {project!r}.")
            scored = None
    if scored is None:
        scored = overview_slice(nodes, node_kinds(registrations=registrations, entrypoints=entrypoints))
    return *graph.select_slice(scored, nodes, edges.where(F.col("kind").isin(kinds)), max_nodes, max_edges), warnings
