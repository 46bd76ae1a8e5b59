"""Text, diagnostics and set queries over documents, conversations, pages, events, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import diagnostics, facts, graph, markup
from ..plans import change, impact
from ..sources.tables import DIAGNOSTICS_SQL, GRAPH_SQL, edges, nodes, read
from ..sources.tables import diagnostics as diagnostics_table
from ..storage import fresh_path
from ..streaming import events as streams
from ..streaming import runs
from .graph import IMPACT_SQL, TARGET

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def query(sql: str | None = None, diagnostic_tables: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {DIAGNOSTICS_SQL}{sql}" if diagnostic_tables else sql
        return f

    return add


def document_files(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+')) AS name FROM documents)
SELECT name FROM t WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY name HAVING count(*) = 1""")
def tokens_once(spark, sf_dir):
    """Identifiers that occur once in all documents."""
    return facts.identifier_counts(document_files(spark, sf_dir)).where("n = 1").select("name")


@query("""
SELECT 'en' AS item, path, score, n_lines FROM (
  SELECT 'docs/' || source || '/' || doc_id AS path, count(*) FILTER (contains(upper(line), 'LICENSE') OR contains(upper(line), 'SRC')) AS n_lines,
    least(80, 10 * count(*) FILTER (contains(upper(line), 'LICENSE') OR contains(upper(line), 'SRC'))) + CASE WHEN contains('D' || doc_id, '99') THEN 60 ELSE 0 END AS score
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id, source
) WHERE score > 0""")
def test_map_score(spark, sf_dir):
    """Documents as test files that concern the names license, src and 99 (in the file name)."""
    d = read(spark, sf_dir, "documents")
    rows = facts.lines(d.select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))
    hits = facts.test_map(rows, ["license", "src"]).select("path", "n_lines")
    named = facts.test_map(rows.select("path", "line", F.lit("").alias("text")), ["99"]).select("path", F.col("score").alias("named"))
    both = hits.join(named, "path", "full").select("path", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("named", F.lit(0)).alias("named"))
    return both.select(F.lit("en").alias("item"), "path", (F.least(F.lit(80), 10 * F.col("n_lines")) + F.col("named")).cast("long").alias("score"), "n_lines")


@query(" SELECT event_id, uri, severity, code FROM diagnostics WHERE severity <= 2 AND upper(code) <> 'PURCHASE' OR severity <= 2 AND code IS NULL", True)
def diag_severity_filter(spark, sf_dir):
    return diagnostics.filtered(diagnostics_table(spark, sf_dir), "WARNING", exclude_codes=["purchase"]).select("event_id", "uri", "severity", "code")


@query(" SELECT uri, count(*) AS n FROM diagnostics WHERE severity <= 2 GROUP BY uri ORDER BY n DESC, uri LIMIT 20", True)
def diag_top_docs(spark, sf_dir):
    return diagnostics.top_documents(diagnostics.filtered(diagnostics_table(spark, sf_dir), "WARNING"), 20)


@query(""" SELECT * FROM (SELECT uri, event_id, CAST(row_number() OVER (PARTITION BY uri ORDER BY start_line, start_char, event_id) AS INT) AS place, count(*) OVER (PARTITION BY uri) AS total,
  greatest(count(*) OVER (PARTITION BY uri) - 10, 0) AS truncated FROM diagnostics WHERE severity <= 2) WHERE place <= 10""", True)
def diag_topk_per_doc(spark, sf_dir):
    return diagnostics.top_per_document(diagnostics.filtered(diagnostics_table(spark, sf_dir), "WARNING"), 10, "event_id").select("uri", "event_id", "place", "total", "truncated")


@query(" SELECT severity, count(*) AS n FROM diagnostics GROUP BY severity", True)
def diag_severity_counts(spark, sf_dir):
    return diagnostics_table(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query("""
SELECT uri, event_id, code FROM (SELECT 'user/' || user_id AS uri, event_id, event_type AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("uri"), "event_id", F.col("event_type").alias("code"), "ts")
    return diagnostics.latest(rows, "uri", "ts", "event_id").select("uri", "event_id", "code")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_by_stream(spark, sf_dir):
    """The events as a stream whose state is the last one of each user."""
    path, schema = fresh_path(spark, "state"), read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type", "ts")  # a pattern: streams take no single file
    runs.merge_stream(stream, path, fresh_path(spark, "state-checkpoint"), "user_id", "ts", "event_id").awaitTermination()
    return runs.read_latest(spark, path).select("user_id", "event_id", "event_type")


@query(f"""SELECT doc_id, CAST(line AS INT) AS line, regexp_extract(text, '(?i)licensed under (the )?([A-Z]+)', 2) AS kind FROM {LINES} WHERE regexp_matches(text, '(?i)licensed under (the )?([A-Z]+)')""")
def line_facts(spark, sf_dir):
    pattern = r"(?i)licensed under (the )?([A-Z]+)"
    rows = facts.lines(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return facts.line_matches(rows, pattern, facts.group(pattern, 2)).select(F.col("path").alias("doc_id"), "line", "kind")


@query("""SELECT page_id, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line FROM (SELECT page_id, substr(html, 1, strpos(html, '<article') - 1) AS head FROM pages WHERE strpos(html, '<article') > 0)""")
def line_number_of_match(spark, sf_dir):
    at = F.instr("html", "<article")
    return read(spark, sf_dir, "pages").where(at > 0).select("page_id", names.line_of_offset(F.col("html"), at - 1).alias("line"))


@query("""
WITH m AS (SELECT conv_id, turn, text, role = 'user' AS sets, role = 'assistant' AS uses, ends_with(text, '?') AS clears FROM conversations), s AS (
  SELECT *, max(CASE WHEN sets THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS set_at, max(CASE WHEN uses OR clears THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM m)
SELECT conv_id, turn, set_at FROM s WHERE uses AND set_at IS NOT NULL AND (ended IS NULL OR ended < set_at)""")
def pending_state(spark, sf_dir):
    """The user turn that each assistant turn answers; a question mark at the end of a turn drops what was pending."""
    c = read(spark, sf_dir, "conversations")
    out = facts.pending_values(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), F.col("role") == "assistant", F.col("text").endswith("?"))
    return out.select("conv_id", "turn", "set_at")


@query("""
SELECT e.event_id, c.event_id AS found_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_enclosing(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    errors, clicks = e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'")
    return graph.as_of(errors, clicks, "user_id", "ts", "ts", "event_id").select("event_id", "found_id")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey AS range_id, epoch(o_orderdate)::BIGINT // 86400 AS first, epoch(o_orderdate)::BIGINT // 86400 + 30 + o_orderkey % 90 AS last, o_orderkey % 3 AS rank FROM orders),
p AS (SELECT o_custkey, o_orderkey AS pos_id, epoch(o_orderdate)::BIGINT // 86400 + 20 AS pos FROM orders)
SELECT pos_id, range_id FROM (SELECT pos_id, range_id, row_number() OVER (PARTITION BY pos_id ORDER BY last - first, rank DESC, range_id) AS k FROM p JOIN r USING (o_custkey) WHERE pos BETWEEN first AND last) WHERE k = 1""")
def range_deepest(spark, sf_dir):
    """Orders open for a while each; of each customer's orders the shortest one open 20 days after each order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"))
    ranges = o.select("path", F.col("o_orderkey").alias("range_id"), F.col("day").alias("first"), (F.col("day") + 30 + F.col("o_orderkey") % 90).alias("last"), (F.col("o_orderkey") % 3).alias("rank"))
    positions = o.select("path", F.col("o_orderkey").alias("pos_id"), (F.col("day") + 20).alias("pos"))
    return graph.deepest_enclosing(positions, ranges).select("pos_id", "range_id")


@query("""
WITH items AS (SELECT page_id AS item_id, split_part(split_part(regexp_replace(url, '^https?://', ''), '?', 1), '#', 1) AS path FROM pages),
owners AS (SELECT DISTINCT split_part(path, '/', 1) AS directory FROM items UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM items WHERE split_part(path, '/', 2) IN ('en', 'fr'))
SELECT item_id, directory FROM (SELECT item_id, directory, row_number() OVER (PARTITION BY item_id ORDER BY length(directory) DESC) AS k FROM items JOIN owners ON starts_with(path, directory || '/')) WHERE k = 1""")
def longest_prefix(spark, sf_dir):
    """Pages to the longest site folder that holds them: hosts, and their English and French sections."""
    path = F.split(F.regexp_replace("url", "^https?://", ""), "[?#]")[0]
    items = read(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), path.alias("path"))
    part = F.split("path", "/")
    owners = items.select(part[0].alias("directory")).union(items.where(F.get(part, F.lit(1)).isin("en", "fr")).select(F.concat_ws("/", part[0], part[1]))).distinct()
    return graph.longest_prefix(items, owners.withColumn("owner_id", F.col("directory"))).select("item_id", "directory")


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS projects FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def ambiguous_names(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count_distinct("p_brand").alias("projects")).where("projects > 1")


HREFS_SQL = "(SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS seq FROM pages)"


def hrefs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("seq", "href")).withColumn("seq", F.col("seq") + 1)


@query(f"SELECT CAST(page_id AS VARCHAR) AS path, href AS name, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS lines FROM {HREFS_SQL} GROUP BY page_id, href HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    own = hrefs(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), F.col("href").alias("name"), F.col("seq").alias("line"))
    return markup.duplicate_names(own).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query(f"SELECT page_id, href, CAST(seq AS INT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY page_id, upper(href) ORDER BY seq) AS k FROM {HREFS_SQL}) WHERE k > 1")
def duplicates_after_first(spark, sf_dir):
    return markup.repeated_after_first(hrefs(spark, sf_dir), [F.col("page_id"), F.upper("href")], [F.col("seq")]).select("page_id", "href", "seq")


@query(f"SELECT DISTINCT '/' || split_part(lower(text), ' ', 1) AS key FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM {HREFS_SQL} h WHERE h.href = '/' || split_part(lower(benchmark.text), ' ', 1))")
def unused_defs(spark, sf_dir):
    """First words of benchmark items as definitions that no page links to (case counts)."""
    defined = read(spark, sf_dir, "benchmark").select(F.lit("all").alias("path"), F.concat(F.lit("/"), F.split(F.lower("text"), " ")[0]).alias("key")).distinct()
    return markup.unused_resources(defined, hrefs(spark, sf_dir).select(F.lit("all").alias("path"), F.col("href").alias("key"))).select("key")


@query(f"SELECT page_id, href AS key FROM {HREFS_SQL} h WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE upper('/' || split_part(d.text, ' ', 1)) = upper(h.href)) AND NOT regexp_matches(lower(href), '^(system|\\{{x:static|\\{{dynamicresource)') AND NOT regexp_matches(href, 'Brush|Color|Font|Theme')")
def missing_refs(spark, sf_dir):
    """Links to words that begin no document, ignoring case."""
    defined = read(spark, sf_dir, "documents").select(F.lit("all").alias("path"), F.concat(F.lit("/"), F.split("text", " ")[0]).alias("key"))
    used = hrefs(spark, sf_dir).select(F.lit("all").alias("path"), "page_id", F.col("href").alias("key"), F.lit(True).alias("is_static"))
    return markup.missing_resources(defined, used).select("page_id", "key")


@query("""
SELECT name, origin, id FROM (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY origin, id) AS k FROM (
  SELECT p_name AS name, 0 AS origin, p_partkey AS id FROM part UNION ALL SELECT upper(p_type), 1, p_partkey FROM part UNION ALL SELECT p_brand, 2, p_partkey FROM part)) WHERE k = 1""")
def keep_first_union(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    parts = [p.select(c.alias("name"), F.lit(i).alias("origin"), F.col("p_partkey").alias("id")) for i, c in enumerate((F.col("p_name"), F.upper("p_type"), F.col("p_brand")))]
    return graph.keep_first(parts[0].unionByName(parts[1]).unionByName(parts[2]), [F.upper("name")], [F.col("origin"), F.col("id")]).select("name", "origin", "id")


@query("SELECT DISTINCT path FROM (SELECT 'src/' || p_name AS path FROM part WHERE p_size > 10) a WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 10 AND p_type LIKE '%O%' AND upper('SRC/' || p_name) = upper(a.path))")
def except_ci(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = p.where("p_size > 10").select(F.lit("caller").alias("section"), F.concat(F.lit("src/"), "p_name").alias("path"))
    targets = p.where("p_size <= 10 and p_type like '%O%'").select(F.lit("target").alias("section"), F.concat(F.lit("SRC/"), "p_name").alias("path"))
    return change.secondary_files(found.unionByName(targets))


@query("""
WITH reg AS (SELECT p_partkey AS reg_id, replace(p_name, ' ', '.') AS type, p_brand AS project FROM part),
use AS (SELECT p_partkey AS use_id, p_brand AS project, unnest([split_part(p_name, ' ', 2), replace(p_name, ' ', '.')]) AS name FROM part),
forms AS (SELECT reg_id, project, type AS name FROM reg UNION SELECT reg_id, project, split_part(type, '.', 2) FROM reg),
amb AS (SELECT name, count(DISTINCT project) AS projects FROM forms GROUP BY name)
SELECT DISTINCT reg_id, use_id FROM use JOIN forms USING (name) JOIN amb USING (name) WHERE projects = 1 OR use.project = forms.project""")
def registration_consumers(spark, sf_dir):
    """Parts as registrations and as consumers of a list of the simple name and of the full name."""
    p = read(spark, sf_dir, "part").withColumn("type", F.replace("p_name", F.lit(" "), F.lit(".")))
    registered = p.select(F.col("p_partkey").alias("reg_id"), "type", F.col("p_brand").alias("project"))
    wrapped = F.array(F.concat(F.lit("IReadOnlyList<"), F.split("p_name", " ")[1], F.lit(">")), F.concat(F.col("type"), F.lit("[]")), F.concat(F.lit("ILogger<"), "type", F.lit(">")))
    used = p.select(F.col("p_partkey").alias("use_id"), F.col("p_brand").alias("project"), wrapped.alias("parameter_types"))
    return facts.registration_consumers(registered, used)


@query("""
WITH reg AS (SELECT p_partkey AS reg_id, replace(p_name, ' ', '.') AS type, p_brand AS project FROM part),
ty AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS display_name, replace(p_name, ' ', '.') AS metadata_name, p_brand AS project FROM part)
SELECT reg_id, id, score FROM (SELECT reg_id, id, score, row_number() OVER (PARTITION BY reg_id ORDER BY score DESC, id) AS k FROM (
  SELECT reg_id, id, CASE WHEN metadata_name = type THEN 300 WHEN display_name = type THEN 260 WHEN ends_with(upper(metadata_name), upper('.' || type)) THEN 180 ELSE 170 END + CASE WHEN ty.project = reg.project THEN 20 ELSE 0 END AS score
  FROM reg JOIN ty ON upper(split_part(type, '.', 2)) = upper(display_name))) WHERE k = 1""")
def registration_best_type(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("type", F.replace("p_name", F.lit(" "), F.lit(".")))
    registered = p.select(F.col("p_partkey").alias("reg_id"), "type", F.col("p_brand").alias("project"))
    types = p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[1].alias("display_name"), F.col("type").alias("metadata_name"), F.col("p_brand").alias("project"))
    return facts.best_types(registered, types)


@query(f"WITH {GRAPH_SQL}{IMPACT_SQL}, d AS (SELECT file_path AS uri, CASE WHEN id LIKE '%1' THEN 1 ELSE 3 END AS severity, id AS message FROM nodes WHERE kind = 'Type')" + """, focus AS (
  SELECT path FROM (SELECT path, rank, row_number() OVER (PARTITION BY upper(path) ORDER BY rank, path) AS k FROM (
    SELECT path, CASE section WHEN 'target' THEN 1 ELSE 2 END AS rank FROM cut WHERE coalesce(trim(path), '') <> '' UNION ALL SELECT 'parts/Brand#1.src', 0)) WHERE k = 1 ORDER BY rank, upper(path) LIMIT 10)
SELECT uri, severity, message FROM d WHERE severity <= 3 AND upper(uri) IN (SELECT upper(path) FROM focus)""")
def verify_change(spark, sf_dir):
    n = nodes(spark, sf_dir)
    found = impact.sections(n, edges(spark, sf_dir), TARGET)
    rows = n.where("kind = 'Type'").select(F.col("file_path").alias("uri"), F.when(F.col("id").endswith("1"), 1).otherwise(3).alias("severity"), F.col("id").alias("message"), F.lit(None).cast("string").alias("code"))
    changed = spark.range(1).select(F.lit("parts/Brand#1.src").alias("path"))
    return change.verify_change(found, changed, rows, "INFO").select("uri", "severity", "message")


@query("""
SELECT p_partkey, p_type || '.' || replace(p_name, ' ', '.') AS q, split_part(p_name, ' ', 2) AS trailing, p_type || '.' || split_part(p_name, ' ', 1) AS container, p_name AS payload,
  replace(p_name, ' ', '-') AS slug, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS spaced, p_name AS type_name FROM part""")
def scalar_names(spark, sf_dir):
    """The name functions over part names."""
    q = F.concat("p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", q.alias("q"), names.trailing_identifier(F.concat(q, F.lit("(int x)"))).alias("trailing"), names.container_prefix(q).alias("container"), names.after_colon(F.concat(F.lit("T:"), "p_name")).alias("payload"),
        names.slug(F.concat(F.lit("#"), F.col("p_name"), F.lit("!"))).alias("slug"), names.collapse_spaces(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t\n ")), F.lit(" "))).alias("spaced"), names.type_name(F.concat(F.lit("global::"), "p_name", F.lit("?"))).alias("type_name"),
    )


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/bin/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'src/obj/' ELSE 'src/' END || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.g.cs' WHEN p_partkey % 11 = 0 THEN 'Test.cs' ELSE '.cs' END AS path FROM part)
SELECT p_partkey, p_partkey % 5 IN (0, 2) AS ignored, p_partkey % 5 IN (0, 2) OR ends_with(path, '.g.cs') AS generated, p_partkey % 5 = 1 OR contains(path, 'Test.cs') AS test_path,
  regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem, '.cs' AS extension FROM p""")
def path_predicates(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "src/bin/").when(k % 5 == 1, "tests/").when(k % 5 == 2, "src\\obj\\").otherwise("src/")
    path = F.concat(folder, k.cast("string"), F.when(k % 7 == 0, ".g.cs").when(k % 11 == 0, "Test.cs").otherwise(".cs"))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select("p_partkey", *[f(F.col("path")).alias(f.__name__) for f in (paths.ignored, paths.generated, paths.test_path, paths.stem, paths.extension)])


@query("""
SELECT 'user/' || user_id AS uri, CAST(sum(n) AS BIGINT) AS edits FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def edit_totals(spark, sf_dir):
    """Events of each user and type as edits of a file, gathered to a map as a rename returns it."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("list"))
    return diagnostics.edit_totals(e.select(F.create_map(F.concat(F.lit("user/"), F.col("user_id").cast("string")), F.col("list")).alias("changes")))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def window_counts(spark, sf_dir):
    return streams.window_counts(read(spark, sf_dir, "events"), "1 day").withColumn("value", F.round("value", 4))


@query("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events"), "2 hours")


@query("""
WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Is' || p_type WHEN 1 THEN p_type || 'Count' WHEN 2 THEN p_type || 'Command' ELSE p_type END AS property FROM part)
SELECT property, CASE p WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'ICommand' ELSE 'object' END AS type FROM (SELECT DISTINCT property, p_partkey % 4 AS p FROM b)""")
def view_model_types(spark, sf_dir):
    """Bindings made of part types, to properties with inferred types."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Is"), "p_type")).when(k % 4 == 1, F.concat("p_type", F.lit("Count"))).when(k % 4 == 2, F.concat("p_type", F.lit("Command"))).otherwise(F.col("p_type"))
    texts = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("{Binding Path="), name, F.lit(".Value, Mode=OneWay}")).alias("value"))
    return markup.view_model(markup.bindings(texts).withColumn("seq", F.col("p_partkey")))
