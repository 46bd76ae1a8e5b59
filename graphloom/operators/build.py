"""The code graph from tables of compiler facts, whole or of the changed projects only.

symbols: symbol_id, parent_id, project_id, project_name, kind (Namespace, Type, Method, Property, Event, Field), method_kind,
is_implicit, display_name, documentation_id, metadata_name. places: symbol_id, path, first_line, first_char, last_line,
last_char (lines from 1) of each declaration. relations: kind (inherits, implements, overrides), symbol_id, target_id.
occurrences: path, line, character, target_id of calls, creations and constructor initialisers. documents: project_id, path.
projects: project_id, project_name, path, references (array of project ids). files (path, content), where given: the text of the
documents and project files, from which registrations and entrypoints are derived (see operators.derived).

Joins are by id, but for the owner of an occurrence, which is the innermost symbol around its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from ..storage import little_disk, materialize, scratch
from . import closure, derived
from .graph import deepest_enclosing, keep_first

# The kinds of methods that are nodes.
METHOD_KINDS = ("Ordinary", "Constructor", "StaticConstructor", "Conversion", "UserDefinedOperator", "DelegateInvoke")
LINE = 1 << 20  # characters of a line in a place's number
SOLUTION = "solution"


def node_id(project: Column, documentation: Column) -> Column:
    return F.concat(F.lit("symbol:"), project, F.lit("::"), documentation)


def document_id(path: Column) -> Column:
    return F.concat(F.lit("document:"), paths.normalized(path))


def counted_places(places: DataFrame, include_generated: bool = False) -> DataFrame:
    """Places in files that count."""
    return places if include_generated else places.where(~paths.generated(F.col("path")))


def included_symbols(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """Symbols with a place (the first by path and offset) that aren't implicit, and of methods those of the wanted kinds."""
    first = places.groupBy("symbol_id").agg(F.min(F.struct("path", "first_line", "first_char")).alias("_first"))
    wanted = ~F.coalesce("is_implicit", F.lit(False)) & ((F.col("kind") != "Method") | F.col("method_kind").isin(*METHOD_KINDS))
    own = symbols.where(wanted).join(first, "symbol_id").withColumns({"file_path": F.col("_first.path"), "line": F.col("_first.first_line"), "character": F.col("_first.first_char") + 1})
    return own.drop("_first").withColumn("id", node_id(F.col("project_name"), F.col("documentation_id")))


def _containers(own: DataFrame, symbols: DataFrame, keep) -> tuple[DataFrame, bool]:
    """symbol_id, id, container: the node around each symbol, written by keep; and whether all were found in the first round, so that none
    is left out. A namespace without a place is passed over, and a symbol in another one that is no node isn't visited, nor what it holds."""
    known = own.select(F.col("symbol_id").alias("up"), F.col("id").alias("up_node"))
    above = symbols.select(F.col("symbol_id").alias("up"), F.col("kind").alias("up_kind"), F.col("parent_id").alias("next"))
    step = own.select("symbol_id", "id", "project_id", F.col("parent_id").alias("up")).join(known, "up", "left")
    found = F.when(F.col("up").isNull(), F.col("project_id")).otherwise(F.col("up_node"))
    state = keep(step.select("symbol_id", "id", "project_id", F.when(F.col("up_node").isNull(), F.col("up")).alias("up"), found.alias("container")), "held")
    done, open_ = state.where("up is null").select("symbol_id", "id", "container"), state.where("up is not null").drop("container")
    if open_.isEmpty():
        return done, True
    while not open_.isEmpty():  # as many rounds as namespaces are nested without a place
        step = open_.join(known, "up", "left").join(above, "up", "left").where("up_node is not null or up_kind = 'Namespace'")
        state = materialize(step.select("symbol_id", "id", "project_id", F.when(F.col("up_node").isNull(), F.col("next")).alias("up"), F.col("up_node").alias("container")), "containers")
        done = done.unionByName(state.where("up is null").select("symbol_id", "id", F.coalesce("container", "project_id").alias("container")))
        open_ = state.where("up is not null").drop("container")
    return keep(done, "held"), False


def _unvisited(links: DataFrame, projects: DataFrame) -> DataFrame | None:
    """The ids that the projects (id) hold, by links (container, id), or None where they hold every container and so all. The closure runs
    over the containers only, which are few."""
    holders = materialize(links.select(F.col("container").alias("id")).distinct(), "holders")
    inner = links.select(F.col("container").alias("source_id"), F.col("id").alias("target_id")).join(holders.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    visited = closure.reachable(inner, projects).select("id")
    if holders.join(visited, "id", "left_anti").isEmpty():
        return None
    return links.join(visited.withColumnRenamed("id", "container"), "container", "left_semi").select("id").distinct()


def symbol_graph(symbols: DataFrame, places: DataFrame, relations: DataFrame, occurrences: DataFrame, include_generated: bool = False, beyond: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the symbols; contains, declared_in, inherits, implements, overrides and calls edges, some more than once.

    beyond: further symbols (symbol_id, id) that edges may point to, of projects that aren't built now.

    Each step is written, narrow, and what it shuffled is deleted before the next; the edges are read from what the steps wrote.
    """

    def number(line: str, char: str) -> Column:
        return F.col(line).cast("long") * LINE + F.col(char)

    spark, spots = symbols.sparkSession, counted_places(places, include_generated)
    with scratch(spark) as keep, little_disk(spark):
        columns = ["symbol_id", "parent_id", "project_id", "id", "kind", "display_name", "project_name", "file_path", "line", "character", "documentation_id", "metadata_name"]
        own = keep(included_symbols(symbols, spots).where("id is not null").select(*columns), "own-symbols")
        held, complete = _containers(own, symbols, keep)
        beyond = beyond if beyond is None else materialize(beyond.select("symbol_id", "id"), "beyond")
        visited = _unvisited(held, own.select(F.col("project_id").alias("id")).distinct())
        if visited is not None or not complete:  # what lies in a symbol that is no node is none either
            visited = materialize(held.select("id").distinct() if visited is None else visited, "visited")
            own, held = keep(own.join(visited, "id", "left_semi").select(*columns), "own-symbols"), keep(held.join(visited, "id", "left_semi").select(*held.columns), "held")
        ids = own.select("symbol_id", "id")
        last = F.max(F.struct("last_line", "last_char"))  # each path and offset of a symbol once
        placed = spots.join(own.select("symbol_id", "id", "kind"), "symbol_id").groupBy("symbol_id", "id", "kind", "path", "first_line", "first_char").agg(last.alias("last"))
        placed = keep(placed.select("id", "kind", "path", number("first_line", "first_char").alias("first"), number("last.last_line", "last.last_char").alias("last")), "placed")
        targets = (ids if beyond is None else ids.unionByName(beyond)).select(F.col("symbol_id").alias("target_id"), F.col("id").alias("target"))
        every = symbols.select(F.col("symbol_id").alias("target_id"), node_id(F.col("project_name"), F.col("documentation_id")).alias("target"))
        every = every if beyond is None else every.unionByName(targets)
        related = keep(relations.join(ids, "symbol_id").join(every, "target_id").select("kind", F.col("id").alias("source_id"), F.col("target").alias("target_id")), "related")
        ranges = placed.where("kind <> 'Namespace'").select(F.col("id").alias("range_id"), "path", "first", "last", F.lit(0).alias("rank"))
        site = F.struct("path", number("line", "character").alias("pos"), "target_id")
        sites = occurrences.select(site.alias("pos_id")).select("pos_id", "pos_id.path", "pos_id.pos")
        called = materialize(deepest_enclosing(sites, ranges).select("range_id", "pos_id.target_id"), "sites")
        called = keep(called.join(targets, "target_id").where("range_id <> target").select(F.col("range_id").alias("source_id"), F.col("target").alias("target_id")), "called")

    nodes = own.select("id", "kind", "display_name", "project_name", F.col("project_id").alias("owning_project_id"), "file_path", F.col("line").cast("int"), F.col("character").cast("int"), "documentation_id", "metadata_name")

    def edges(rows: DataFrame, kind: str, source: str, target: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(source).alias("source_id"), target.alias("target_id"))

    out = edges(held, "contains", "container", F.col("id")).unionByName(edges(placed, "declared_in", "id", document_id(F.col("path"))))
    return nodes, out.unionByName(related).unionByName(edges(called, "calls", "source_id", F.col("target_id")))


def workspace_graph(projects: DataFrame, documents: DataFrame, name: str = "solution", include_generated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The solution, its projects and their documents, with contains and depends_on_project edges."""
    spark, none, no_line = projects.sparkSession, F.lit(None).cast("string"), F.lit(None).cast("int")
    columns = [c.split(" ")[0] for c in schema.NODES.split(", ")]

    def node(rows: DataFrame, **own: Column) -> DataFrame:
        base = dict.fromkeys(columns, none) | {"line": no_line, "character": no_line} | own
        return rows.select(*[base[c].alias(c) for c in columns])

    docs = (documents if include_generated else documents.where(~paths.generated(F.col("path")))).join(projects.select("project_id", "project_name"), "project_id")
    nodes = node(spark.range(1), id=F.lit(SOLUTION), kind=F.lit("Solution"), display_name=F.lit(name))
    nodes = nodes.unionByName(node(projects, id=F.col("project_id"), kind=F.lit("Project"), display_name=F.col("project_name"), project_name=F.col("project_name"), owning_project_id=F.col("project_id"), file_path=F.col("path")))
    nodes = nodes.unionByName(node(docs, id=document_id(F.col("path")), kind=F.lit("Document"), display_name=paths.basename(F.col("path")), project_name=F.col("project_name"), owning_project_id=F.col("project_id"), file_path=F.col("path")))
    edges = projects.select(F.lit("contains").alias("kind"), F.lit(SOLUTION).alias("source_id"), F.col("project_id").alias("target_id"))
    edges = edges.unionByName(docs.select(F.lit("contains").alias("kind"), F.col("project_id").alias("source_id"), document_id(F.col("path")).alias("target_id")))
    depends = projects.select(F.lit("depends_on_project").alias("kind"), F.col("project_id").alias("source_id"), F.explode("references").alias("target_id"))
    known = projects.select(F.col("project_id").alias("target_id"))
    return nodes, edges.unionByName(depends.join(known, "target_id", "left_semi").select("kind", "source_id", "target_id")).distinct()


def reuse_refused(previous: dict | None, info, target: str, options: str) -> str | None:
    """Why a stored snapshot can't be built upon, or None where it can."""
    if previous is None:
        return "no snapshot of this schema"
    if info.target.replace("\\", "/").rstrip("/") != target.replace("\\", "/").rstrip("/"):
        return "another workspace"
    if info.options != options:
        return "other options"
    return "no project fingerprints" if previous["project_states"].isEmpty() else None


def build_graph(facts: dict[str, DataFrame], states: DataFrame, previous: dict[str, DataFrame] | None = None, include_generated: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, project_states, rebuilt (project ids) and the derived facts, from facts: symbols, places, relations, occurrences,
    documents, projects and, if there, files.

    With a previous snapshot, projects whose fingerprint (states) changed and all that depend on them are built anew; the
    nodes and edges that other projects own stay. Edges of the solution and between projects are always new. Source text is
    read of changed projects only; what was derived from other projects' text comes from the snapshot, and the nodes and edges
    of registrations and entrypoints are joined anew from all of it, since names link them across projects. The snapshot's tables are
    read several times, so they should be stored ones.
    """
    nodes, edges = workspace_graph(facts["projects"], facts["documents"], include_generated=include_generated)
    stale = changed = facts["projects"].select(F.col("project_id").alias("id"))
    if previous is not None:
        changed = closure.changed_states(states, previous["project_states"]).select(F.col("project_id").alias("id"))
        depends = edges.where("kind = 'depends_on_project'").select("source_id", "target_id")
        stale = closure.stale_projects(changed, depends).select("id")
    stale = materialize(stale.distinct(), "stale")
    mine = stale.withColumnRenamed("id", "project_id")
    symbols = facts["symbols"].join(mine, "project_id", "left_semi")
    files = facts["documents"].join(mine, "project_id", "left_semi").select("path")
    beyond = None if previous is None else included_symbols(facts["symbols"], counted_places(facts["places"], include_generated))
    built_nodes, built_edges = symbol_graph(symbols, facts["places"], facts["relations"], facts["occurrences"].join(files, "path", "left_semi"), include_generated, beyond)
    nodes, edges = nodes.unionByName(built_nodes), edges.unionByName(built_edges)
    if previous is not None:
        alive = facts["projects"].select(F.col("project_id").alias("owning_project_id"))
        kept = previous["nodes"].where(~F.col("kind").isin("Solution", "Project", "Document", *derived.KINDS)).join(alive, "owning_project_id", "left_semi").join(stale.withColumnRenamed("id", "owning_project_id"), "owning_project_id", "left_anti")
        nodes = nodes.unionByName(kept.select(*nodes.columns))
        owned = previous["edges"].where(~F.col("kind").isin("depends_on_project")).select("kind", "source_id", "target_id")
        with little_disk(stale.sparkSession):
            from_kept = owned.join(kept.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*owned.columns)
            of_projects = owned.where("kind = 'contains'").join(alive.withColumnRenamed("owning_project_id", "source_id"), "source_id", "left_semi")
            under_project = of_projects.join(kept.select(F.col("id").alias("target_id"), F.col("owning_project_id").alias("source_id")), ["target_id", "source_id"], "left_semi").select(*owned.columns)
            edges = edges.unionByName(materialize(from_kept.unionByName(under_project), "kept-edges"))
    found = derived.derive(facts, changed, previous)
    if found:
        found = {name: materialize(rows, name) for name, rows in found.items()}
        nodes = materialize(nodes, "symbol-nodes")
        more = derived.graph(found, nodes)
        nodes, edges = nodes.unionByName(more[0]), edges.unionByName(more[1])
    return {"nodes": keep_first(nodes, [F.col("id")], [F.col("kind"), F.col("file_path")]), "edges": edges.distinct(), "project_states": states, "rebuilt": stale, **found}


def has_calls(edges: DataFrame) -> bool:
    return not edges.where("kind = 'calls'").isEmpty()
