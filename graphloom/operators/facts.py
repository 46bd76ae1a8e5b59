"""Located facts from source text: pattern scans over lines and whole files, and the joins between facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths
from ..storage import materialize
from . import bloom, lexer
from .graph import keep_first, top_per_key
from .name_scan import names_held

# The patterns that name facts.
ROUTE = r"\b\w+\.(Map(?:Get|Post|Put|Delete|Patch|Group))\s*\("
HOSTED_SERVICE = r"AddHostedService<([^>]+)>"
BACKGROUND_SERVICE = r"class\s+([A-Za-z_][A-Za-z0-9_]*)\s*:\s*BackgroundService\b"
SERVERLESS = r"\bpublic\s+(?:async\s+)?(?:Task(?:<[^>]+>)?|void)\s+([A-Za-z_][A-Za-z0-9_]*Handler)\s*\(([^)]*\bILambdaContext\b[^)]*)\)"
MIDDLEWARE = r"\bapp\.(Use[A-Z][A-Za-z0-9_]*)\s*\("
REGISTRATION = r"\b\w+\.((?:TryAdd|Add)(Scoped|Singleton|Transient))<([^>]*)>\s*\((.*?)\)\s*;"
ENUMERABLE = r"\b\w+\.TryAddEnumerable\s*\(\s*ServiceDescriptor\.(Singleton|Scoped|Transient)<([^,>]+)\s*,\s*([^>]+)>\s*\(\s*\)\s*\)"
FACTORY = r"GetRequiredService<([^>]+)>\s*\("
NEW = r"new\s+([A-Za-z_][A-Za-z0-9_<>,\.\?]*)\s*\("
PRIMARY_CONSTRUCTOR = r"(?:\b(?:public|internal|private|protected|file|sealed|abstract|partial|static)\s+)*(?:class|record)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
CONSTRUCTOR = r"(?:\b(?:public|internal|private|protected)\s+)([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
HANDLER = r"\.(AddHttpMessageHandler)\s*<([^>]+)>\s*\("
CONFIGURE = r"Configure<([^>]+)>\s*\("
ADD_OPTIONS = r"AddOptions<([^>]+)>"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
PRIVATE_METHOD = r"\bprivate\s+(?:(?:static|async|unsafe|extern|new|partial|virtual|sealed|override)\s+)*([A-Za-z_][A-Za-z0-9_<>,\.\[\]\?\s:]*)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
PRIVATE_FIELD = r"\bprivate\s+(?:(?:static|readonly|volatile|const|required|unsafe|new)\s+)*([A-Za-z_][A-Za-z0-9_<>,\.\[\]\?]*)\s+(_?[A-Za-z_][A-Za-z0-9_]*)\s*(?:=|;)"
INTERNAL_TYPE = r"\binternal\s+((?:(?:sealed|abstract|static|partial)\s+)*)(?:class|record|interface|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)\b"
STATIC_METHOD = r"\b(?:public|internal|private)\s+static\s+[A-Za-z_][A-Za-z0-9_<>,\.\[\]\?\s:]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
TYPE_DECLARATION = r"\b(?:class|record|interface|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"
STARTUP_CALL = r"\b(app|builder(?:\.Services|\.Host)?|services|host)\.((?:Use|Map|Add)[A-Z][A-Za-z0-9_]*)\s*\("
COLLECTIONS = ("IEnumerable", "IReadOnlyCollection", "IReadOnlyList", "ICollection", "IList", "List")
MODES = ("aspnet_endpoints", "hosted_services", "di_registrations", "config_bindings", "middleware_pipeline")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line; \\r\\n counts as \\n."""
    return files.select("path", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def source_files(files: DataFrame, tests: bool = True, short_generated: bool = False) -> DataFrame:
    """Files outside ignored folders; without tests, only production files that nobody generated."""
    out = files.where(~paths.ignored(F.col("path")))
    if tests:
        return out
    made = paths.generated_short(F.col("path")) if short_generated else paths.generated(F.col("path"))
    return out.where(~paths.test_path(F.col("path")) & ~made)


def line_matches(rows: DataFrame, pattern: str, kind: Column) -> DataFrame:
    """kind, path, line, trimmed text of the lines that match."""
    return rows.where(F.col("text").rlike(pattern)).select(kind.alias("kind"), "path", "line", F.trim("text").alias("text"))


def group(pattern: str, n: int) -> Column:
    return F.regexp_extract("text", pattern, n)


def routes(rows: DataFrame) -> DataFrame:
    return line_matches(rows, ROUTE, group(ROUTE, 1))


def hosted_services(rows: DataFrame) -> DataFrame:
    registered = line_matches(rows, HOSTED_SERVICE, F.concat(F.lit("registration:"), names.type_name(group(HOSTED_SERVICE, 1))))
    return registered.unionByName(line_matches(rows, BACKGROUND_SERVICE, F.concat(F.lit("implementation:"), group(BACKGROUND_SERVICE, 1))))


def serverless_handlers(rows: DataFrame) -> DataFrame:
    return line_matches(rows, SERVERLESS, group(SERVERLESS, 1))


def middleware(rows: DataFrame) -> DataFrame:
    return line_matches(rows, MIDDLEWARE, group(MIDDLEWARE, 1))


def endpoint_composition(rows: DataFrame) -> DataFrame:
    """Distinct lines that start with app.Map and are no route."""
    text = F.trim("text")
    return rows.where(text.startswith("app.Map") & ~F.col("text").rlike(ROUTE)).select(F.rtrim(text, F.lit(";")).alias("text")).distinct()


def pending_values(rows: DataFrame, key: str, position: str, sets: Column, uses: Column, clears: Column) -> DataFrame:
    """Ordered rows with the value that is pending where it is used.

    A row sets the value (sets not null), then may use it, then may clear it; a use clears it too. So a use finds the
    last value set at or before it if no row since then, itself left out, has used or cleared it.
    """
    order = W.partitionBy(key).orderBy(position)
    upto, before = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, -1)
    at = F.col(position)
    marked = rows.withColumns({"_set": sets, "_use": F.coalesce(uses, F.lit(False)), "_clear": F.coalesce(clears, F.lit(False))})
    last = F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("value"), at.alias("at"))), ignorenulls=True).over(upto)
    ended = F.last(F.when(F.col("_use") | F.col("_clear"), at), ignorenulls=True).over(before)
    state = marked.withColumns({"_last": last, "_ended": ended})
    return state.where(F.col("_use") & F.col("_last").isNotNull() & (F.col("_ended").isNull() | (F.col("_ended") < F.col("_last.at")))).select(*rows.columns, F.col("_last.value").alias("value"), F.col("_last.at").alias("set_at"))


def config_bindings(rows: DataFrame) -> DataFrame:
    trimmed = rows.withColumn("text", F.trim("text"))
    section = F.col("text").contains("GetSection(")
    direct = line_matches(trimmed.where(section), CONFIGURE, F.concat(F.lit("configure:"), names.type_name(group(CONFIGURE, 1))))
    option = group(ADD_OPTIONS, 1)
    pending = pending_values(trimmed, "path", "line", F.when(option != "", names.type_name(option)), F.col("text").contains(".Bind(") & section, F.col("text").endswith(";"))
    return direct.unionByName(pending.select(F.concat(F.lit("bind:"), "value").alias("kind"), "path", F.col("set_at").alias("line"), names.collapse_spaces(F.col("text")).alias("text")))


def _all_matches(pattern: str, groups: int, inside: str = ""):
    """A vectorised function: per text all matches as (offset, groups). Offsets of matches are beyond the SQL functions.

    inside "()": what the bracket at the start of the last group encloses takes the place of that group, so brackets and strings within
    don't end it. inside "{}": the text in the next pair of braces after a match is one group more. Both by the lexer.
    """
    compiled = re.compile(pattern, re.S)

    def found(text: str) -> list[re.Match]:
        return list(compiled.finditer(text))

    def rows(text: str, matches: list[re.Match], enclosed: list[str | None]) -> list[dict]:
        out, line, at = [], 1, 0
        for i, m in enumerate(matches):
            line += text.count("\n", at, m.start())
            at = m.start()
            own = [m.group(n + 1) or "" for n in range(groups)]
            if inside == "()":
                own[-1] = own[-1] if enclosed[i] is None else enclosed[i]
            elif inside:
                own.append(enclosed[i] or "")
            out.append({"line": line, "end": m.end(), "whole": m.group(0), "groups": own})
        return out

    def apply(texts: pd.Series) -> pd.Series:
        texts = ["" if t is None else t for t in texts]
        matches = [found(t) for t in texts]
        around = [[]] * len(texts)
        if inside:
            around = lexer.enclosed(texts, [[m.start(groups) - 1 if inside == "()" else m.end() for m in own] for own in matches], *inside, here=inside == "()")
        return pd.Series([rows(*each) for each in zip(texts, matches, around)], dtype=object)

    return F.pandas_udf(apply, "array<struct<line:int,end:int,whole:string,groups:array<string>>>")


def file_matches(files: DataFrame, pattern: str, groups: int, inside: str = "") -> DataFrame:
    """path, line, end (offset after the match), whole, groups of every match in the files, over lines. Contents stay behind.

    inside: brackets whose content a group holds (see _all_matches)."""
    found = files.where(F.col("content").rlike("(?s)" + pattern)).select("path", _all_matches(pattern, groups, inside)("content").alias("found"))
    return found.select("path", F.explode("found").alias("m")).select("path", "m.line", "m.end", "m.whole", "m.groups")


def registrations(files: DataFrame) -> DataFrame:
    """service, implementation, lifetime, path, line, source_text, is_factory, is_enumerable of the container registrations."""
    types = F.split(F.col("groups")[2], ",")
    arguments = F.col("groups")[3]
    factory, made = F.regexp_extract(arguments, FACTORY, 1), F.regexp_extract(arguments, NEW, 1)
    second = names.type_name(types[1])
    inferred = F.when(F.size(types) > 1, second).when(factory != "", names.type_name(factory)).when(made != "", names.type_name(made)).when(arguments.contains("=>"), F.lit("factory")).otherwise(names.type_name(types[0]))
    plain = file_matches(files, REGISTRATION, 4).select(
        names.type_name(types[0]).alias("service"), inferred.alias("implementation"), F.col("groups")[1].alias("lifetime"), "path", "line",
        names.collapse_spaces(F.col("whole")).alias("source_text"), arguments.contains("=>").alias("is_factory"), F.lit(False).alias("is_enumerable"),
    )
    many = file_matches(files, ENUMERABLE + r"\s*;", 3).select(
        names.type_name(F.col("groups")[1]).alias("service"), names.type_name(F.col("groups")[2]).alias("implementation"), F.col("groups")[0].alias("lifetime"), "path", "line",
        names.collapse_spaces(F.col("whole")).alias("source_text"), F.lit(False).alias("is_factory"), F.lit(True).alias("is_enumerable"),
    )
    return plain.unionByName(many)


def _parameter_types(parameters: pd.Series) -> pd.Series:
    return pd.Series(lexer.parameter_types(["" if p is None else p for p in parameters]), dtype=object)


def parameter_types(parameters: Column) -> Column:
    """Types of a parameter list (see lexer.parameter_types)."""
    return F.pandas_udf(_parameter_types, "array<string>")(parameters)


def consumers(files: DataFrame) -> DataFrame:
    """path, line, display, parameter_types of primary constructors, constructors and message handlers."""
    first = file_matches(files, PRIMARY_CONSTRUCTOR, 2, "()")
    second = file_matches(files, CONSTRUCTOR, 2, "()")
    built = first.unionByName(second).select("path", "line", names.collapse_spaces(F.concat(F.col("groups")[0], F.lit("("), F.col("groups")[1], F.lit(")"))).alias("display"), parameter_types(F.col("groups")[1]).alias("parameter_types"))
    handlers = file_matches(files, HANDLER, 2).select("path", "line", names.collapse_spaces(F.col("whole")).alias("display"), F.array(names.type_name(F.col("groups")[1])).alias("parameter_types"))
    return keep_first(built.where(F.size("parameter_types") > 0).unionByName(handlers), [F.col("path"), F.col("line"), F.col("display")], [F.size("parameter_types")])


def registration_consumers(registered: DataFrame, used: DataFrame) -> DataFrame:
    """registered (reg_id, type, project) and used (use_id, project, parameter_types): pairs where a parameter is the type, its simple
    name, one of the collection wrappers of it or an array of it. A type name of several projects matches only in its own.

    Wrappers are stripped from the parameters, so both forms are equi-joins: by name and project, or by name alone where one project has it.
    Registrations of the same names, and consumers of the same names, are a class each; pairs of classes are made and made distinct, and
    only then become pairs of their members. So no pair is made that isn't a result, and no table of pairs is shuffled but that of classes.
    """
    wrapped = rf"^(?:{'|'.join(COLLECTIONS)})<(.+)>$"
    raw = used.select("use_id", F.col("project").alias("use_project"), F.explode("parameter_types").alias("p"))
    inner = F.when(F.col("p").rlike(wrapped), F.regexp_extract("p", wrapped, 1)).when(F.col("p").endswith("[]"), F.regexp_replace("p", r"\[\]$", "")).otherwise(F.col("p"))
    wanted = raw.select("use_id", "use_project", names.type_name(inner).alias("name"))
    forms = registered.select("reg_id", "project", F.explode(F.array_distinct(F.array("type", names.simple_type_name(F.col("type"))))).alias("name"))
    shared = forms.groupBy("name").agg(F.count_distinct("project").alias("projects"))

    def classes(rows: DataFrame, key: str, project: str, name: str) -> DataFrame:
        """key and its class, the sorted array of the names (with their project, unless one alone has them) that it meets others by."""
        alone = F.col("projects") == 1
        by = F.struct("name", (~alone).alias("own"), F.when(alone, F.lit("")).otherwise(F.col(project).cast("string")).alias("project"))
        met = rows.join(shared, "name").where(alone | F.col(project).isNotNull())
        return met.groupBy(key).agg(F.array_sort(F.collect_set(by)).alias(name))

    regs, uses = classes(forms, "reg_id", "project", "reg_class"), classes(wanted, "use_id", "use_project", "use_class")
    ways = [rows.select(name).distinct().select(name, F.explode(name).alias("by")) for rows, name in ((regs, "reg_class"), (uses, "use_class"))]
    pairs = ways[0].join(ways[1], "by").select("reg_class", "use_class").distinct()
    return pairs.join(regs, "reg_class").select("reg_id", "use_class").join(uses, "use_class").select("reg_id", "use_id")


def matching_registrations(registered: DataFrame, query: str | None) -> DataFrame:
    """Registrations whose service, implementation, path or source text holds the query, ignoring case; all without one."""
    if not (query and query.strip()):
        return registered
    said = names.fold_ci(F.concat_ws("\n", "service", "implementation", "path", "source_text"))
    return registered.where(said.contains(names.fold_text(query.strip())))


def registration_report(registered: DataFrame, used: DataFrame | None, query: str | None = None, k: int = 50) -> DataFrame:
    """The first k registrations that match, in order of service, implementation, path and line, with place, total, the first k of
    their consumers and truncated_consumers. Both tables have a column project; without consumers (used) the lists are empty.

    A name that several projects register is ambiguous over all that match, not only the first k.
    """
    own = matching_registrations(registered, query)
    order = [*[names.fold_ci(F.coalesce(c, F.lit(""))) for c in ("service", "implementation", "path")], F.col("line"), F.col("source_text")]
    top = top_per_key(own.withColumn("all", F.lit(0)), ["all"], order, k).drop("all", "truncated")
    if used is None:
        return top.withColumns({"consumers": F.array().cast("array<string>"), "truncated_consumers": F.lit(0).cast("long")})
    key = F.xxhash64("project", "path", "line", "service", "implementation", "source_text")
    own, top = own.withColumn("reg_id", key), top.withColumn("reg_id", key)
    users = used.select("project", "path", "line", "display", "parameter_types").withColumn("use_id", F.struct("path", "line", "display"))
    types = own.select("reg_id", "project", F.explode(F.array("service", "implementation")).alias("type")).where(~names.blank(F.col("type")) & (F.lower("type") != "factory"))
    pairs = registration_consumers(types, users.select("use_id", "project", "parameter_types")).join(top.select("reg_id"), "reg_id", "left_semi").select("reg_id", "use_id.*")
    first = top_per_key(pairs, ["reg_id"], [names.fold_ci("path"), F.col("line"), F.col("display")], k)
    text = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "display")
    lists = first.groupBy("reg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x.text).alias("consumers"), F.max("truncated").alias("truncated_consumers"))
    return top.join(lists, "reg_id", "left").withColumns({"consumers": F.coalesce("consumers", F.array().cast("array<string>")), "truncated_consumers": F.coalesce("truncated_consumers", F.lit(0)).cast("long")}).drop("reg_id")


def registrations_that_concern(registered: DataFrame, used: DataFrame, candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """Registrations whose service or implementation holds a candidate name (name, folded), or that a consumer in one of the projects
    (project) uses whose text holds one. The candidates are the names of a change's targets, of which a file may have many."""
    key = F.xxhash64("project", "path", "line", "service", "implementation")
    keyed = registered.withColumn("reg_id", key)
    said = names_held(keyed, F.concat_ws("\n", "service", "implementation"), candidates, ["reg_id"]).select("reg_id").distinct()
    users = used.join(projects.select("project").distinct(), "project", "left_semi").withColumn("use_id", F.struct("path", "line", "display"))
    near = users.join(names_held(users, F.col("display"), candidates, ["use_id"]).select("use_id").distinct(), "use_id", "left_semi")
    types = keyed.select("reg_id", "project", F.explode(F.array("service", "implementation")).alias("type")).where(~names.blank(F.col("type")))
    pairs = registration_consumers(types, near.select("use_id", "project", "parameter_types"))
    return keyed.join(said.union(pairs.select("reg_id")).distinct(), "reg_id", "left_semi").select(*registered.columns).distinct()


def declared_types(files: DataFrame, path: str) -> DataFrame:
    """(name): the name of the file without its extension, and the types that it declares; paths are compared as everywhere, ignoring case."""
    own = files.where(names.fold_ci(paths.normalized(F.col("path"))) == names.fold_text(path.replace("\\", "/")))
    found = F.concat(F.array(paths.stem(F.col("path"))), F.regexp_extract_all("content", F.lit(TYPE_DECLARATION), 1))
    return own.select(F.explode(F.array_distinct(found)).alias("name")).where(~names.blank(F.col("name")))


def test_report(rows: DataFrame, candidates: list[str], k: int = 20, lines_each: int = 3) -> DataFrame:
    """The best k of test_map with place and total, the first lines that name a candidate, and the number of further ones."""
    best = top_per_key(test_map(rows, candidates).withColumn("all", F.lit(0)), ["all"], [F.desc("score"), names.fold_ci("path"), F.col("path")], k).drop("all", "truncated")
    own = rows.join(best.select("path"), "path", "left_semi")
    wanted = rows.sparkSession.createDataFrame([(c,) for c in candidates], "name string")
    hits = own.join(names_held(own, F.col("text"), wanted, ["path", "line"]).select("path", "line").distinct(), ["path", "line"], "left_semi")
    first = top_per_key(hits.select("path", "line", F.trim("text").alias("text")), ["path"], [F.col("line"), F.col("text")], lines_each)
    text = F.concat(F.col("line").cast("string"), F.lit(": "), "text")
    lists = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x.text).alias("lines"), F.max("truncated").alias("more_lines"))
    return best.join(lists, "path", "left").withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "more_lines": F.coalesce("more_lines", F.lit(0)).cast("long")})


def best_types(registered: DataFrame, types: DataFrame) -> DataFrame:
    """registered (reg_id, type, project) and types (id, display_name, metadata_name, project): the best node of each type name.

    A type matches by its metadata name (300), its display name (260), the end of its metadata name after a dot (180) or
    its simple name (170), and 20 more in the same project. Types are first cut to one for each way, name and project, so
    a name that many types bear meets one row for each way. A name that nothing matches gets no node.
    """
    upper, dotted = names.fold_ci("metadata_name"), F.split("metadata_name", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(dotted), F.lit(2))), lambda n: F.array_join(F.slice(F.split(upper, r"\."), n, F.size(dotted)), "."))
    simple = names.fold_ci(names.trailing_identifier(F.col("display_name")))

    def way(score: int, keys: Column) -> Column:
        return F.transform(F.coalesce(keys, F.array()), lambda k: F.struct(F.lit(score).alias("way"), k.alias("key")))

    ways = [way(300, F.array("metadata_name")), way(260, F.array("display_name")), way(180, F.when(F.size(dotted) > 1, ends)), way(170, F.array(simple))]
    known = types.select("id", F.col("project").alias("own"), F.explode(F.concat(*ways)).alias("w")).select("id", "own", "w.way", "w.key").where("key is not null")
    folded = names.fold_ci("type")
    asked = [way(300, F.array("type")), way(260, F.array("type")), way(180, F.array(folded)), way(170, F.array(names.fold_ci(names.simple_type_name(F.col("type")))))]
    wanted = registered.select("reg_id", "project", F.explode(F.concat(*asked)).alias("w")).select("reg_id", "project", "w.way", "w.key")
    near = known.groupBy("way", "key", F.col("own").alias("project")).agg(F.min("id").alias("id"))
    far = near.groupBy("way", "key").agg(F.min("id").alias("id"))
    found = wanted.join(near, ["way", "key", "project"]).select("reg_id", "id", (F.col("way") + 20).alias("score")).unionByName(wanted.join(far, ["way", "key"]).select("reg_id", "id", F.col("way").alias("score")))
    return keep_first(found, [F.col("reg_id")], [F.desc("score"), F.col("id")]).select("reg_id", "id", "score")


def identifiers(files: DataFrame) -> DataFrame:
    """(name): every identifier in the files, as often as it stands there."""
    return files.select(F.explode(F.regexp_extract_all("content", F.lit(IDENTIFIER), 0)).alias("name"))


def identifier_counts(files: DataFrame) -> DataFrame:
    return identifiers(files).groupBy("name").agg(F.count("*").alias("n"))


def dead_code(files: DataFrame) -> DataFrame:
    """kind, name, path, line, evidence of private methods, private fields and internal types whose name occurs once in all files.

    The declared names are found first and make a Bloom filter; only identifiers that pass it are shuffled and counted, exactly.
    """

    def declared(pattern: str, kind: str, inside: str = "") -> DataFrame:
        groups = F.col("groups")
        members = F.regexp_extract_all(groups[2], F.lit(STATIC_METHOD), 1) if inside else F.array().cast("array<string>")
        found = file_matches(files, pattern, 2, inside).select(F.lit(kind).alias("kind"), groups[1].alias("name"), "path", "line", F.when(groups[0].contains("static"), members).alias("members"))
        return found

    parts = [declared(PRIVATE_METHOD, "private-method"), declared(PRIVATE_FIELD, "private-field"), declared(INTERNAL_TYPE, "internal-type", "{}")]
    rows = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "declared")
    asked = rows.select(F.explode(F.concat(F.array("name"), F.coalesce("members", F.array().cast("array<string>")))).alias("name")).distinct()
    counted = identifiers(files).where(bloom.may_be_in(asked, "name", F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))
    once = materialize(counted.where("n = 1").select("name"), "once")
    alone = rows.join(once, "name", "left_semi")
    types = F.col("kind") == "internal-type"
    methods = alone.where(types).select("path", "line", F.explode("members").alias("member"))
    used = methods.join(once.withColumnRenamed("name", "member"), "member", "left_anti").select("path", "line").distinct().withColumn("kind", F.lit("internal-type"))
    text = F.when(types, "type name appears only in its declaration").otherwise("identifier appears only in its declaration")
    return alone.join(used, ["path", "line", "kind"], "left_anti").select("kind", "name", "path", "line", text.alias("evidence"))


def startup_calls(rows: DataFrame) -> DataFrame:
    """name, line of the start-up calls in Program.cs, once for each name and line."""
    own = rows.where(F.lower(paths.basename(F.col("path"))) == "program.cs")
    found = own.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(STARTUP_CALL), 2)).alias("name"))
    return keep_first(found, [names.fold_ci("name"), F.col("path"), F.col("line")], [F.col("name")])


def semantic_search(files: DataFrame, mode: str) -> DataFrame:
    """One of the named searches over production files: kind, path, line, text in order of path, line and kind."""
    own = source_files(files, tests=False)
    if mode == "di_registrations":
        found = registrations(own).select(F.concat_ws(":", "lifetime", "service").alias("kind"), "path", "line", F.col("source_text").alias("text"))
    elif mode in MODES:
        found = {"aspnet_endpoints": routes, "hosted_services": hosted_services, "config_bindings": config_bindings, "middleware_pipeline": middleware}[mode](lines(own))
    else:
        raise ValueError(f"unknown mode {mode!r}; the modes are {', '.join(MODES)}")
    return found.orderBy(names.fold_ci("path"), "line", "kind")


def test_map(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """rows: lines of test files (path, line, text). path, score, reasons (joined), n_lines of the files that concern a candidate name.

    100 for a file named after a candidate, 60 where its name holds one, and 10 for each line that does, 80 at most. Of names that
    differ in case only, the first spelling counts.
    """
    spark, order = rows.sparkSession, {}
    for c in candidates:
        order.setdefault(names.fold_text(c), c)
    order.pop("", None)
    wanted = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(order.items())], "name string, candidate string, place int")
    held = names_held(rows, F.col("text"), wanted, ["path", "line"])
    per_file = held.select("path", "line").distinct().groupBy("path").agg(F.count("*").alias("n_lines"))
    files = rows.select("path").distinct().withColumn("stem", names.fold_ci(paths.stem(F.col("path"))))
    said = names_held(files, F.col("stem"), wanted, ["path", "stem"]).join(wanted, "name")
    named = (F.col("stem") == F.concat("name", F.lit("TESTS"))) | (F.col("stem") == F.concat("name", F.lit("TEST")))
    each = said.select("path", "place", F.when(named, 100).otherwise(60).alias("points"), F.concat(F.when(named, "file:").otherwise("file-contains:"), "candidate").alias("reason"))
    by_name = each.groupBy("path").agg(F.sum("points").alias("points"), F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda x: x.reason).alias("reasons"))
    both = per_file.join(by_name, "path", "full").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)).cast("long"))
    score = F.least(F.lit(80), 10 * F.col("n_lines")) + F.coalesce("points", F.lit(0))
    content = F.when(F.col("n_lines") > 0, F.concat(F.lit("content:"), F.col("n_lines").cast("string")))
    return both.select("path", score.cast("long").alias("score"), F.concat_ws(",", F.col("reasons"), content).alias("reasons"), "n_lines").where("score > 0")
