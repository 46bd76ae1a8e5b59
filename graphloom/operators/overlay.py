"""Registrations and entrypoints as nodes and edges on top of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths
from . import facts
from .graph import as_of, keep_first


def with_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """rows (path) with project_id and project_name of the project (project_id, project_name, path of its file) whose folder holds the path;
    the nearest folder wins, and rows in no project's folder drop out."""
    folders = projects.select("project_id", "project_name", F.regexp_replace(paths.normalized(F.col("path")), r"/?[^/]*$", "").alias("folder"))
    found = rows.select("path", F.explode(F.concat(F.array(F.lit("")), paths.prefixes(F.col("path")))).alias("folder")).distinct().join(folders, "folder")
    nearest = keep_first(found, [F.col("path")], [F.desc(F.char_length("folder")), F.col("project_id")]).select("path", "project_id", "project_name")
    return rows.join(nearest, "path")


def project_by_segment(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """rows (path) with the project whose name is a folder of the path; the longest name wins. Folders are exploded, so it is an equi-join."""
    known = projects.select("project_id", "project_name", names.fold_ci("project_name").alias("_name"))
    folder = F.explode(F.slice(F.split(names.fold_ci(paths.normalized(F.col("path"))), "/"), F.lit(1), F.greatest(F.size(F.split(paths.normalized(F.col("path")), "/")) - 1, F.lit(0))))
    found = rows.select("path", folder.alias("_name")).distinct().join(known, "_name")
    return rows.join(keep_first(found, [F.col("path")], [F.desc(F.char_length("project_name")), F.col("project_id")]).select("path", "project_id", "project_name"), "path")


def _node(rows: DataFrame, id_: Column, kind: str, display: Column, documentation: Column, metadata: Column) -> DataFrame:
    return rows.select(
        id_.alias("id"), F.lit(kind).alias("kind"), display.alias("display_name"), "project_name", F.col("project_id").alias("owning_project_id"), F.col("path").alias("file_path"),
        F.col("line").cast("int").alias("line"), F.lit(1).alias("character"), documentation.alias("documentation_id"), metadata.alias("metadata_name"),
    )


def _owned(nodes: DataFrame) -> DataFrame:
    """contains and declared_in edges of overlay nodes."""
    above = nodes.select(F.lit("contains").alias("kind"), F.col("owning_project_id").alias("source_id"), F.col("id").alias("target_id"))
    return above.unionByName(nodes.select(F.lit("declared_in").alias("kind"), F.col("id").alias("source_id"), F.concat(F.lit("document:"), paths.normalized(F.col("file_path"))).alias("target_id")))


def entrypoints(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found (category, path, line, text, project_id, project_name) to nodes and edges."""
    id_ = F.concat(F.lit("entrypoint:"), "category", F.lit(":"), paths.normalized(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.sha2("text", 256))
    nodes = _node(found, id_, "Entrypoint", F.col("text"), names.pack(F.lit("entrypoint"), F.col("category"), F.lit(""), F.col("text")), F.col("category"))
    return nodes, _owned(nodes)


def host_entrypoints(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runnable projects (project_id, project_name, path, type and, where they have one, program: the file that starts them) as entrypoints."""
    hosts = projects.where(F.col("type").isin("web", "worker", "lambda", "executable")).withColumn("line", F.lit(1))
    id_ = F.concat(F.lit("entrypoint:host_project:"), paths.normalized(F.col("path")), F.lit(":1:"), F.sha2("project_name", 256))
    if "program" in projects.columns:
        hosts, id_ = hosts.withColumn("host_id", id_).withColumn("path", F.coalesce("program", "path")), F.col("host_id")
    nodes = _node(hosts, id_, "Entrypoint", F.col("project_name"), names.pack(F.lit("entrypoint"), F.lit("host_project"), F.col("project_name"), F.concat("type", F.lit(" host"))), F.col("type"))
    return nodes, _owned(nodes)


# Which kind of node stands for a line that several begin on.
KIND_RANK = {"Method": 4, "Property": 3, "Event": 3, "Type": 2, "Field": 1}
NO_MEMBER = ("Project", "Document", "Namespace")


def enclosing_members(sites: DataFrame, members: DataFrame) -> DataFrame:
    """sites (use_id, path, line, project_name) and nodes (id, kind, project_name, file_path, line) to use_id, id: the last node at or
    before the site's line in its file, of the site's project where there is one; of a line's nodes that of the highest kind."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_RANK.items() for x in pair]), F.col("kind")), F.lit(0))
    own = members.where(~names.blank(F.col("file_path")) & F.col("line").isNotNull() & ~F.col("kind").isin(*NO_MEMBER))
    own = own.select("id", paths.normalized(F.col("file_path")).alias("file"), "line", names.fold_ci(F.coalesce("project_name", F.lit(""))).alias("project"), rank.alias("rank"))
    asked = sites.select("use_id", paths.normalized(F.col("path")).alias("file"), F.col("line").alias("use_line"), names.fold_ci(F.coalesce("project_name", F.lit(""))).alias("project"))
    found = None
    for key in (F.concat_ws("\n", "file", "project"), F.col("file")):
        first = keep_first(own.withColumn("key", key), [F.col("key"), F.col("line")], [F.desc("rank"), F.col("id")]).select("id", "key", "line")
        near = as_of(asked.withColumn("key", key), first, "key", "use_line", "line", "id").where("found_id is not null").select("use_id", F.col("found_id").alias("id"))
        found = near if found is None else found.unionByName(near.join(found.select("use_id"), "use_id", "left_anti"))
    return found


def registrations(registered: DataFrame, used: DataFrame, types: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations (service, implementation, ..., path, line, project_id, project_name) as nodes, with edges to the types that they
    name and to what consumes them.

    used: consumers (path, line, display, parameter_types, project_name). types: (id, display_name, metadata_name, project). members:
    nodes of symbols, among which a consumer's place finds its own (see enclosing_members).
    """
    shown = F.when(names.blank(F.col("implementation")), F.concat_ws(" ", "lifetime", "service")).otherwise(F.concat("lifetime", F.lit(" "), "service", F.lit(" -> "), "implementation"))
    id_ = F.concat_ws(":", F.lit("registration"), "project_id", paths.normalized(F.col("path")), F.col("line").cast("string"), "service", F.coalesce("implementation", F.lit("")))
    form = [F.when(F.col("is_factory"), "factory").otherwise("direct"), F.when(F.col("is_enumerable"), "enumerable").otherwise("single")]
    own = registered.withColumn("reg_id", id_)
    nodes = _node(own, F.col("reg_id"), "DiRegistration", shown, names.pack(F.lit("di"), F.col("lifetime"), F.col("service"), F.coalesce("implementation", F.lit("")), *form), F.col("source_text"))
    named = own.select("reg_id", F.col("project_name").alias("project"), F.explode(F.array("service", "implementation")).alias("type")).where(~names.blank(F.col("type")) & (F.lower("type") != "factory")).distinct()
    keyed = named.withColumn("key", F.concat_ws("\n", "reg_id", "type"))
    linked = facts.best_types(keyed.select(F.col("key").alias("reg_id"), "type", "project"), types)
    to_types = linked.select(F.lit("registered_as").alias("kind"), F.substring_index("reg_id", "\n", 1).alias("source_id"), F.col("id").alias("target_id"))
    uses = used.withColumn("use_id", F.concat_ws("|", "path", F.col("line").cast("string"), "display"))
    pairs = facts.registration_consumers(named.select("reg_id", "type", "project"), uses.select("use_id", F.col("project_name").alias("project"), "parameter_types"))
    nearest = enclosing_members(uses.select("use_id", "path", "line", "project_name"), members)
    to_users = pairs.join(nearest, "use_id").select(F.lit("consumed_by").alias("kind"), F.col("reg_id").alias("source_id"), F.col("id").alias("target_id"))
    return nodes, _owned(nodes).unionByName(to_types).unionByName(to_users).distinct()


def entrypoint_files(files: DataFrame, per_project: int = 3) -> DataFrame:
    """files (path, content, project_id): Program.cs, and of each project the first few worker and serverless files."""
    own = files.where(~paths.ignored(F.col("path")))
    worker = F.lower("path").rlike(r"(worker|hostedservice|backgroundservice)\.cs$")
    handler = F.col("content").contains("ILambdaContext") & F.col("content").contains("Handler(")
    kind = F.when(F.lower(paths.basename(F.col("path"))) == "program.cs", "program").when(worker, "worker").when(handler, "serverless")
    from .graph import top_per_key

    top = top_per_key(own.select("project_id", "path", kind.alias("kind")).where("kind is not null"), ["project_id", "kind"], [names.fold_ci("path"), F.col("path")], per_project)
    return top.select("project_id", "path", "kind")


# Words before "(" that call nothing.
KEYWORDS = ("base", "catch", "default", "else", "for", "foreach", "if", "lock", "nameof", "new", "return", "sizeof", "switch", "typeof", "using", "while")


def invocation_probes(rows: DataFrame, symbol: str, most: int = 24) -> DataFrame:
    """rows (path, line, text): the lines of one member. name, path, line of the calls in its body, the first `most` by place.

    The body begins after the first "{" or "=>". Keywords, the member itself and names after new, class or record are no calls.
    """
    from pyspark.sql import Window as W

    code = names.strip_comment(F.col("text"))
    opened = F.max(F.col("text").rlike(r"\{|=>").cast("int")).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    body = rows.withColumn("_open", opened).where("_open = 1").withColumn("code", F.when(F.col("text").rlike(r"^[^{]*=>|^[^=]*\{"), F.regexp_replace(code, r"^.*?(\{|=>)", "")).otherwise(code))
    bare = F.regexp_replace("code", r"\b(new|class|record)\s+[A-Za-z_][A-Za-z0-9_<>,.]*\s*\(", "(")
    calls = body.select("path", "line", F.posexplode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)).alias("pos", "name"))
    wanted = calls.where(~F.col("name").isin(*KEYWORDS) & (F.col("name") != symbol))
    return keep_first(wanted, [names.fold_ci("name"), F.col("path")], [F.col("line"), F.col("pos")]).orderBy("path", "line", "pos").limit(most).select("name", "path", "line")
