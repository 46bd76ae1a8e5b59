"""Queries about one symbol: search with a fallback to its simple name, and all that is known of it in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores
from ..functions.paths import test_path
from ..operators import graph, overlay


def search_key(query: str) -> str:
    """What every answer to a search holds in its name or container: the last name of the query."""
    simple = query.strip().split("(")[0]
    return simple if simple.endswith(".") else simple.rsplit(".", 1)[-1]


def search(symbols: DataFrame, query: str) -> DataFrame:
    """symbols (id, name, container_name, path, ...) that hold the query or, of a dotted query, its last name: with score and
    fallback (whether only the last name does). Of a dotted query, only strong matches where there are any."""
    q, simple = query.strip(), search_key(query)
    whole = names.contains_ci(F.concat_ws(".", "container_name", "name"), F.lit(q))
    last = names.contains_ci(F.col("name"), F.lit(simple))
    own = symbols.where(F.coalesce(whole | last, F.lit(False)))
    own = own.withColumns({"score": scores.symbol_search_score(q, F.col("name"), F.col("container_name"), F.col("path")), "fallback": ~F.coalesce(whole, F.lit(False))})
    if "." not in q:
        return own
    dotted = F.concat_ws(".", "container_name", "name")
    strong = F.coalesce(names.equals_ci(dotted, F.lit(q)) | names.ends_with_ci(dotted, F.lit("." + q)) | (F.lit(q.split(".")[-1]).eqNullSafe(F.col("name")) & scores.path_matches(q, F.col("path"))), F.lit(False))
    some = own.agg(F.max(strong).alias("some"))
    return own.join(F.broadcast(some), ~F.col("some") | strong).drop("some")  # some is one row


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), test_path(F.col("path")), names.fold_ci("name"), names.fold_ci(F.coalesce("container_name", F.lit(""))), "id")


def analysis_score(query: str, name: Column, container: Column) -> Column:
    """How well a symbol answers the query of an analysis: name, last name, qualified name and container add up."""
    q = query.strip()
    simple, prefix = q.split("(")[0], q.rsplit(".", 1)[0] if "." in q else None
    simple = simple if simple.endswith(".") else simple.rsplit(".", 1)[-1]

    def steps(x: Column, to: str, same: int, folded: int, *more: tuple[Column, int]) -> Column:
        out = F.when(x == to, same).when(names.fold_ci(x) == names.fold_text(to), folded)
        for test, n in more:
            out = out.when(test, n)
        return F.coalesce(out.otherwise(0), F.lit(0))

    folded = names.fold_ci(name)
    score = steps(name, q, 500, 450, (name.startswith(q), 400), (folded.startswith(names.fold_text(q)), 350), (folded.contains(names.fold_text(q)), 250))
    if simple != q:
        score += steps(name, simple, 475, 425, (folded.contains(names.fold_text(simple)), 225))
    has = ~names.blank(container)
    qualified = F.when(has, F.concat_ws(".", container, name)).otherwise(name)
    score += steps(qualified, q, 600, 550, (names.fold_ci(qualified).endswith(names.fold_text(q)), 300))
    if prefix:
        score += F.when(has, steps(container, prefix, 350, 325, (names.fold_ci(container).endswith(names.fold_text(prefix)), 200))).otherwise(0)
    return score


def resolve(symbols: DataFrame, query: str | None = None, path: str | None = None, line: int = -1, character: int = -1) -> DataFrame:
    """The one symbol at a position (the innermost), or the best answer to a query; a position goes before a query."""
    if path and line >= 0 and character >= 0:
        at = F.struct(F.lit(line).alias("line"), F.lit(character).alias("char"))
        here = (F.struct(F.col("start_line").alias("line"), F.col("start_char").alias("char")) <= at) & (F.struct(F.col("end_line").alias("line"), F.col("end_char").alias("char")) >= at)
        return symbols.where((F.col("path") == path) & here).orderBy(F.desc("start_line"), F.desc("start_char"), "end_line", "end_char", "id").limit(1)
    if not (query and query.strip()):
        raise ValueError("give a symbol query, or a file path with line and character")
    score = analysis_score(query, F.col("name"), F.col("container_name"))
    return symbols.withColumn("answer", score).where("answer > 0").orderBy(F.desc("answer"), test_path(F.col("path")), "path", "start_line", "id").limit(1).drop("answer")


def analyze(symbol: DataFrame, nodes: DataFrame, edges: DataFrame, definitions: DataFrame, occurrences: DataFrame, lines: DataFrame | None = None, k: int = 20) -> DataFrame:
    """section, place, id, path, line, detail, total, truncated of all that is known of one symbol (id): definitions, references,
    tests that refer to it, implementations, incoming and outgoing calls, supertypes and subtypes, each the first k.

    definitions and occurrences: symbol_id, path, line. Outgoing calls that the graph doesn't know are guessed from the symbol's
    lines (path, line, text), where these are given.
    """
    ids = symbol.select("id")
    columns = ["section", "id", "path", "line", "detail"]

    def section(name: str, rows: DataFrame, detail: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.col("id"), "path", F.col("line").cast("int").alias("line"), detail.cast("string").alias("detail"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("symbol_id").alias("id"), "path", "line").join(ids, "id", "left_semi")

    def near(kinds: list[str], incoming: bool) -> DataFrame:
        return graph.neighbors(edges, nodes, ids, kinds, incoming).withColumnRenamed("file_path", "path")

    references = placed(occurrences)
    outgoing = near(["calls"], False)
    out = section("definition", placed(definitions), F.lit(None))
    for name, rows, detail in (
        ("reference", references, F.lit(None)),
        ("test", references.where(test_path(F.col("path"))), F.lit(None)),
        ("implementation", near(["implements", "inherits", "overrides"], True), F.col("display_name")),
        ("incoming call", near(["calls"], True), F.col("display_name")),
        ("outgoing call", outgoing, F.col("display_name")),
        ("supertype", near(["implements", "inherits"], False), F.col("display_name")),
        ("subtype", near(["implements", "inherits"], True), F.col("display_name")),
    ):
        out = out.unionByName(section(name, rows, detail))
    if lines is not None and outgoing.isEmpty():
        own = symbol.first()  # one row
        if own is not None:
            body = lines.where((F.col("path") == own.path) & F.col("line").between(own.start_line, own.end_line))
            out = out.unionByName(section("outgoing call", overlay.invocation_probes(body, own.name).withColumn("id", F.lit(None).cast("string")), F.col("name")))
    order = [names.fold_ci(F.coalesce("path", F.lit(""))), F.col("line"), F.col("id"), F.col("detail")]
    return graph.top_per_key(out.select(*columns), ["section"], order, k)


def hover_text(contents: Column) -> Column:
    """The text of a hover's contents as JSON: a string, an object with a value, or an array of either, line by line; else as it is."""
    raw = F.trim(contents)
    one = lambda x: F.coalesce(F.get_json_object(x, "$.value"), F.when(x.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string").v), x)
    items = F.from_json(raw, "array<string>")
    return F.rtrim(F.when(raw.startswith("["), F.array_join(F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.value"), x)), "\n")).otherwise(one(raw)))


def hover(table: DataFrame, path: str, line: int, character: int) -> DataFrame:
    """path, text of the hovers (path, start_line, start_char, end_line, end_char, contents) at a position, the innermost first."""
    at = F.struct(F.lit(line), F.lit(character))
    here = table.where((F.col("path") == path) & (F.struct("start_line", "start_char") <= at) & (F.struct("end_line", "end_char") >= at))
    return here.orderBy(F.desc("start_line"), F.desc("start_char"), "end_line", "end_char").limit(1).select("path", hover_text(F.col("contents")).alias("text"))
