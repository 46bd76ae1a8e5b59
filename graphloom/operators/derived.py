"""What a graph build derives from source text: registrations, their consumers, entrypoints and runnable projects.

Scanning text is the dear part, so its facts are stored with the graph, each with the project and file it comes from
(schema.DERIVED), and a build scans the documents of changed projects only. The nodes and edges on top of the facts are joins
by name over all of them: a name may link projects that don't refer to each other, and whether it is ambiguous depends on
every project. Facts are few against text, so these joins are made anew in each build, which is why an incremental build
equals a whole one.

Edge cases: a document of several projects gives its facts to each; files that are no document give none; a null content
gives none; two projects of one name (ignoring case) are an error, since runnable projects are found by name; no table of files
and no earlier facts: nothing is derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import names, paths
from ..sources import text
from . import facts, overlay
from .graph import keep_first

KINDS = ("Entrypoint", "DiRegistration")


def unique_names(projects: DataFrame) -> DataFrame:
    """projects with key, their folded name, by which other tables find them; raises where two have the same."""
    keyed = projects.withColumn("key", names.fold_ci("project_name"))
    twice = [r.key for r in keyed.groupBy("key").agg(F.count_distinct("project_id").alias("n")).where("n > 1").orderBy("key").limit(3).collect()]
    if twice:
        raise ValueError(f"several projects are named {', '.join(twice)}")
    return keyed


def scan(files: DataFrame, documents: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """The facts of all files that are documents of the projects, by table."""
    owners = documents.join(projects.select("project_id", "project_name"), "project_id").select("path", "project_id", "project_name").distinct()
    own = files.join(owners.select("path").distinct(), "path", "left_semi")
    production = facts.lines(facts.source_files(own, tests=False))
    hosted = facts.hosted_services(production)
    kinds = [
        ("aspnet_route", facts.routes(production)), ("hosted_service_registration", hosted.where(F.col("kind").startswith("registration:"))),
        ("background_service", hosted.where(F.col("kind").startswith("implementation:"))), ("serverless_handler", facts.serverless_handlers(production)),
    ]
    entries = None
    for category, rows in kinds:
        rows = rows.select(F.lit(category).alias("category"), "path", "line", "text")
        entries = rows if entries is None else entries.unionByName(rows)
    source = facts.source_files(own)
    found = {"registrations": facts.registrations(source), "consumers": facts.consumers(source), "entrypoints": entries.distinct()}
    return {name: rows.join(owners, "path").select(*_columns(name)) for name, rows in found.items()} | {"hosts": hosts(files, owners, projects)}


def hosts(files: DataFrame, owners: DataFrame, projects: DataFrame) -> DataFrame:
    """The type of each project by its file, found by name, and its first Program.cs."""
    read = text.read_projects(files).select(names.fold_ci("name").alias("key"), F.col("path").alias("project_file"), "type")
    read = keep_first(read, [F.col("key")], [F.col("project_file")])
    programs = owners.where(F.lower(paths.basename(F.col("path"))) == "program.cs")
    first = keep_first(programs, [F.col("project_id")], [names.fold_ci("path"), F.col("path")]).select("project_id", F.col("path").alias("program"))
    return unique_names(projects).join(read, "key").drop("path").withColumnRenamed("project_file", "path").join(first, "project_id", "left").select(*_columns("hosts"))


def _columns(name: str) -> list:
    return [F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.DERIVED[name].split(", ")]


def derive(given: dict[str, DataFrame], changed: DataFrame, previous: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """The facts of all projects: scanned of the changed ones (id), those of the others as they were. Empty without files and earlier facts."""
    alive, out = given["projects"].select("project_id").distinct(), {}
    own = given["projects"].join(changed.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    if "files" in given:
        unique_names(given["projects"])
        out = scan(given["files"], given["documents"].join(own.select("project_id"), "project_id", "left_semi"), own)
    if previous is not None and set(schema.DERIVED) <= set(previous):
        for name in schema.DERIVED:
            kept = previous[name].join(alive, "project_id", "left_semi").join(own.select("project_id"), "project_id", "left_anti").select(*_columns(name))
            out[name] = out[name].unionByName(kept) if name in out else kept
    return out


def graph(found: dict[str, DataFrame], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entrypoint and registration nodes, and their edges, among the nodes of symbols and projects."""
    documents = nodes.where("kind = 'Document'").select(F.col("id").alias("target_id"))
    types = nodes.where("kind = 'Type'").select("id", "display_name", "metadata_name", F.col("project_name").alias("project"))
    parts = [overlay.entrypoints(found["entrypoints"]), overlay.host_entrypoints(found["hosts"]), overlay.registrations(found["registrations"], found["consumers"], types, nodes)]
    out, edges = parts[0]
    for more_nodes, more_edges in parts[1:]:
        out, edges = out.unionByName(more_nodes), edges.unionByName(more_edges)
    declared = edges.where("kind = 'declared_in'").join(documents, "target_id", "left_semi").select("kind", "source_id", "target_id")
    return out, edges.where("kind <> 'declared_in'").unionByName(declared)
