"""Queries over source text made of the parts table, and over a graph built from the driver tables as compiler facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema, storage
from ..operators import build, facts
from ..plans import export, symbols
from ..sources.tables import GRAPH_SQL, edges, nodes, read
from .graph import case

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: One file for each brand, with a statement for each of its parts in order of key: a registration, a route, a hosted service, an
#: options binding over two lines, a middleware call, or a class that is built from an earlier part's service.
SOURCE_SQL = """
WITH src AS (
  SELECT p_partkey AS k, p_brand AS brand, 'src/' || p_brand || '/Wiring.cs' AS path, p_partkey % 6 AS form,
    CAST(1 + sum(CASE WHEN p_partkey % 6 = 3 THEN 2 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - CASE WHEN p_partkey % 6 = 3 THEN 2 ELSE 1 END AS INT) AS line
  FROM part
)"""


def source(spark, sf_dir):
    k = F.col("p_partkey").cast("string")

    def line(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    form = F.col("p_partkey") % 6
    text = (
        F.when(form == 0, line("services.AddScoped<IPart", k, ", Part", k, ">();"))
        .when(form == 1, line('app.MapGet("/parts/', k, '", x => x);'))
        .when(form == 2, line("services.AddHostedService<Worker", k, ">();"))
        .when(form == 3, line("services.AddOptions<Options", k, '>()\n    .Bind(configuration.GetSection("s', k, '"));'))
        .when(form == 4, line("app.UsePart", k, "();"))
        .otherwise(line("public class Consumer", k, "(IReadOnlyList<IPart", (F.col("p_partkey") - 5).cast("string"), "> parts) { }"))
    )
    rows = read(spark, sf_dir, "part").select("p_brand", F.struct("p_partkey", text.alias("text")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.text), "\n")  # a file is one row by nature
    return rows.groupBy("p_brand").agg(whole.alias("content")).select(F.concat(F.lit("src/"), "p_brand", F.lit("/Wiring.cs")).alias("path"), "content")


@query(SOURCE_SQL + " SELECT 'Scoped:IPart' || k AS kind, path, line, 'services.AddScoped<IPart' || k || ', Part' || k || '>();' AS text FROM src WHERE form = 0")
def source_registrations(spark, sf_dir):
    return facts.semantic_search(source(spark, sf_dir), "di_registrations")


@query(SOURCE_SQL + """ SELECT 'MapGet' AS kind, path, line, 'app.MapGet("/parts/' || k || '", x => x);' AS text FROM src WHERE form = 1""")
def source_endpoints(spark, sf_dir):
    return facts.semantic_search(source(spark, sf_dir), "aspnet_endpoints")


@query(SOURCE_SQL + " SELECT 'registration:Worker' || k AS kind, path, line, 'services.AddHostedService<Worker' || k || '>();' AS text FROM src WHERE form = 2")
def source_hosted_services(spark, sf_dir):
    return facts.semantic_search(source(spark, sf_dir), "hosted_services")


@query(SOURCE_SQL + """ SELECT 'bind:Options' || k AS kind, path, line, '.Bind(configuration.GetSection("s' || k || '"));' AS text FROM src WHERE form = 3""")
def source_bindings(spark, sf_dir):
    return facts.semantic_search(source(spark, sf_dir), "config_bindings")


@query(SOURCE_SQL + " SELECT 'UsePart' || k AS kind, path, line, 'app.UsePart' || k || '();' AS text FROM src WHERE form = 4")
def source_middleware(spark, sf_dir):
    return facts.semantic_search(source(spark, sf_dir), "middleware_pipeline")


@query(SOURCE_SQL + """ SELECT r.path AS path, r.line AS line, c.path AS consumer_path, c.line AS consumer_line FROM src r JOIN src c ON c.form = 5 AND c.k = r.k + 5 WHERE r.form = 0""")
def source_consumers(spark, sf_dir):
    """Registrations of the source files and the classes that are built from their services."""
    own = source(spark, sf_dir)
    named = own.select("path", F.split("path", "/")[1].alias("project"))
    registered = facts.registrations(own).join(named, "path").select(F.struct("path", "line").alias("reg_id"), F.col("service").alias("type"), "project")
    used = facts.consumers(own).join(named, "path").select(F.struct("path", "line").alias("use_id"), "project", "parameter_types")
    pairs = facts.registration_consumers(registered, used)
    return pairs.select("reg_id.path", "reg_id.line", F.col("use_id.path").alias("consumer_path"), F.col("use_id.line").alias("consumer_line"))


@query(SOURCE_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY upper('IPart' || k), upper('Part' || k), upper(path), line) AS place, count(*) OVER () AS total FROM src WHERE form = 0 AND contains('IPart' || k, '7'))
SELECT CAST(place AS INT) AS place, total, 'IPart' || k AS service, path, line, CAST((SELECT count(*) FROM src c WHERE c.form = 5 AND c.k = r.k + 5) AS BIGINT) AS consumers FROM r WHERE place <= 50""")
def registration_report(spark, sf_dir):
    """The first 50 registrations whose text holds a 7 in the service's name, with the number of their consumers."""
    own = source(spark, sf_dir)
    named = own.select("path", F.split("path", "/")[1].alias("project"))
    registered = facts.registrations(own).join(named, "path").where(F.col("service").contains("7"))
    found = facts.registration_report(registered, facts.consumers(own).join(named, "path"), "ipart", 50)
    return found.select("place", "total", "service", "path", "line", F.size("consumers").cast("long").alias("consumers"))


@query(SOURCE_SQL + " SELECT path, CAST(count(*) AS BIGINT) AS types FROM src WHERE form = 5 GROUP BY path")
def source_declared_types(spark, sf_dir):
    """Classes that each source file declares."""
    found = source(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("content", F.lit(facts.TYPE_DECLARATION), 1)).alias("name"))
    return found.groupBy("path").agg(F.count("*").alias("types"))


@query("""
WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS name, p_type || '.' || split_part(p_name, ' ', 1) AS container FROM part), u AS (SELECT *, upper(name) AS n, upper(container) AS c, upper(container || '.' || name) AS w FROM s)
SELECT p_partkey, CAST(CASE WHEN name = 'blue.ring' THEN 500 WHEN n = 'BLUE.RING' THEN 450 WHEN starts_with(name, 'blue.ring') THEN 400 WHEN starts_with(n, 'BLUE.RING') THEN 350 WHEN contains(n, 'BLUE.RING') THEN 250 ELSE 0 END
  + CASE WHEN name = 'ring' THEN 475 WHEN n = 'RING' THEN 425 WHEN contains(n, 'RING') THEN 225 ELSE 0 END
  + CASE WHEN container || '.' || name = 'blue.ring' THEN 600 WHEN w = 'BLUE.RING' THEN 550 WHEN ends_with(w, 'BLUE.RING') THEN 300 ELSE 0 END
  + CASE WHEN container = 'blue' THEN 350 WHEN c = 'BLUE' THEN 325 WHEN ends_with(c, 'BLUE') THEN 200 ELSE 0 END AS INT) AS score FROM u""")
def analysis_score(spark, sf_dir):
    """How well parts, as symbols, answer an analysis of blue.ring."""
    name = F.split("p_name", " ")
    rows = read(spark, sf_dir, "part").select("p_partkey", name[1].alias("name"), F.concat("p_type", F.lit("."), name[0]).alias("container"))
    return rows.select("p_partkey", symbols.analysis_score("blue.ring", F.col("name"), F.col("container")).cast("int").alias("score"))


def compiler_facts(spark, sf_dir):
    """Regions as projects, nations as namespaces, customers as types with a file each, orders as methods of four lines; each order's
    second line calls the type of the customer at a tenth of its number."""
    none = F.lit(None).cast("string")
    places_ = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read(spark, sf_dir, "customer").join(places_, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    project = F.concat(F.lit("project:"), F.col("r_regionkey").cast("string"))
    path = F.concat_ws("/", "r_name", "n_name", F.concat("c_name", F.lit(".src")))
    first = (F.col("o_orderkey") % 300 * 5 + 10).cast("int")

    def symbol(rows, key, number, parent, kind, method, name, doc):
        return rows.select(F.concat(F.lit(key), F.col(number).cast("string")).alias("symbol_id"), parent.alias("parent_id"), project.alias("project_id"), F.col("r_name").alias("project_name"), F.lit(kind).alias("kind"), F.lit(method).cast("string").alias("method_kind"), F.lit(False).alias("is_implicit"), name.alias("display_name"), doc.alias("documentation_id"), name.alias("metadata_name"))

    def place(rows, key, number, where, a, b):
        return rows.select(F.concat(F.lit(key), F.col(number).cast("string")).alias("symbol_id"), where.alias("path"), a.alias("first_line"), F.lit(0).alias("first_char"), b.alias("last_line"), F.lit(9).alias("last_char"))

    order = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))
    own = symbol(places_, "n", "n_nationkey", none, "Namespace", None, F.col("n_name"), F.concat(F.lit("N:"), "n_name"))
    own = own.unionByName(symbol(customers, "c", "c_custkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "Type", None, F.col("c_name"), F.concat(F.lit("T:"), "n_name", F.lit("."), "c_name")))
    own = own.unionByName(symbol(orders, "o", "o_orderkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "Method", "Ordinary", order, F.concat(F.lit("M:"), "n_name", F.lit("."), "c_name", F.lit("."), order)))
    spots = place(places_, "n", "n_nationkey", F.concat_ws("/", "r_name", F.concat("n_name", F.lit(".src"))), F.lit(1), F.lit(9))
    spots = spots.unionByName(place(customers, "c", "c_custkey", path, F.lit(1), F.lit(2000))).unionByName(place(orders, "o", "o_orderkey", path, first, first + 3))
    called = F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 10).cast("string"))
    projects = read(spark, sf_dir, "region").select(project.alias("project_id"), F.col("r_name").alias("project_name"), F.concat("r_name", F.lit("/"), "r_name", F.lit(".proj")).alias("path"), F.when(F.col("r_regionkey") > 0, F.array(F.lit("project:0"))).otherwise(F.array().cast("array<string>")).alias("references"))
    return {
        "symbols": own, "places": spots, "projects": projects, "documents": customers.select(project.alias("project_id"), path.alias("path")),
        "relations": customers.where("c_custkey >= 10").select(F.lit("inherits").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol_id"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("target_id")),
        "occurrences": orders.where("o_custkey >= 10").select(path.alias("path"), (first + 1).alias("line"), F.lit(2).alias("character"), called.alias("target_id")),
    }


BUILD_SQL = """
WITH places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), customers AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey),
c AS (SELECT *, 'symbol:' || r_name || '::T:' || n_name || '.' || c_name AS id, r_name || '/' || n_name || '/' || c_name || '.src' AS path FROM customers),
o AS (SELECT o_orderkey, o_custkey, 'symbol:' || r_name || '::M:' || n_name || '.' || c_name || '.Order' || o_orderkey AS id, c.id AS type_id, path, r_regionkey, o_orderkey % 300 * 5 + 10 AS first FROM orders JOIN c ON o_custkey = c_custkey),
e AS (
  SELECT 'contains' AS kind, 'solution' AS source_id, 'project:' || r_regionkey AS target_id FROM region
  UNION SELECT 'contains', 'project:' || r_regionkey, 'document:' || path FROM c
  UNION SELECT 'contains', 'project:' || r_regionkey, 'symbol:' || r_name || '::N:' || n_name FROM places
  UNION SELECT 'contains', 'symbol:' || r_name || '::N:' || n_name, id FROM c
  UNION SELECT 'contains', type_id, id FROM o
  UNION SELECT 'declared_in', 'symbol:' || r_name || '::N:' || n_name, 'document:' || r_name || '/' || n_name || '.src' FROM places
  UNION SELECT 'declared_in', id, 'document:' || path FROM c UNION SELECT 'declared_in', id, 'document:' || path FROM o
  UNION SELECT 'depends_on_project', 'project:' || r_regionkey, 'project:0' FROM region WHERE r_regionkey > 0
  UNION SELECT 'inherits', a.id, b.id FROM c a JOIN c b ON b.c_custkey = a.c_custkey // 10 WHERE a.c_custkey >= 10
  UNION SELECT 'calls', owner, b.id FROM (
    SELECT s.o_custkey, m.id AS owner, row_number() OVER (PARTITION BY s.o_orderkey ORDER BY m.id) AS k FROM o s JOIN o m ON m.o_custkey = s.o_custkey AND s.first + 1 BETWEEN m.first AND m.first + 3
  ) JOIN c b ON b.c_custkey = o_custkey // 10 WHERE k = 1 AND o_custkey >= 10
)"""


def _states(spark, rows):
    return rows.select("project_id", F.col("project_name").alias("name"), F.col("path").alias("file_path"), F.lit("1").alias("fingerprint"), F.col("references").alias("referenced_project_ids"))


@query(BUILD_SQL + " SELECT kind, source_id, target_id FROM e")
def build_graph_edges(spark, sf_dir):
    own = compiler_facts(spark, sf_dir)
    return build.build_graph(own, _states(spark, own["projects"]))["edges"].select("kind", "source_id", "target_id")


@query(BUILD_SQL + """ SELECT id, kind, file_path, CAST(line AS INT) AS line FROM (
  SELECT 'solution' AS id, 'Solution' AS kind, NULL AS file_path, NULL AS line UNION ALL SELECT 'project:' || r_regionkey, 'Project', r_name || '/' || r_name || '.proj', NULL FROM region
  UNION ALL SELECT 'document:' || path, 'Document', path, NULL FROM c UNION ALL SELECT 'symbol:' || r_name || '::N:' || n_name, 'Namespace', r_name || '/' || n_name || '.src', 1 FROM places
  UNION ALL SELECT id, 'Type', path, 1 FROM c UNION ALL SELECT id, 'Method', path, first FROM o)""")
def build_graph_nodes(spark, sf_dir):
    own = compiler_facts(spark, sf_dir)
    return build.build_graph(own, _states(spark, own["projects"]))["nodes"].select("id", "kind", "file_path", "line")


@query(BUILD_SQL + " SELECT kind, source_id, target_id FROM e")
def build_graph_incremental(spark, sf_dir):
    """A graph whose first project lacked a fingerprint, brought up to date: that project and its dependents are built anew."""
    own = compiler_facts(spark, sf_dir)
    states = _states(spark, own["projects"])
    with storage.scratch(spark) as keep, storage.little_disk(spark):
        before = build.build_graph(own, states)
        old = {name: keep(before[name], f"old-{name}") for name in ("nodes", "edges")}
    old["project_states"] = states.withColumn("fingerprint", F.when(F.col("project_id") == "project:3", "0").otherwise(F.col("fingerprint")))
    return build.build_graph(own, states, old)["edges"].select("kind", "source_id", "target_id")


OVERVIEW_SQL = f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT *, CASE WHEN kind = 'Solution' THEN 1000 ELSE 900 END AS score FROM nodes WHERE kind IN ('Solution', 'Project')),
top AS (SELECT * FROM s ORDER BY score DESC, {case('kind', schema.NODE_PRIORITY, 10)} DESC, upper(coalesce(project_name, '')), upper(coalesce(file_path, '')), upper(display_name), id LIMIT 80)"""


@query(OVERVIEW_SQL + " SELECT id, score FROM top")
def export_overview(spark, sf_dir):
    return export.select(nodes(spark, sf_dir), edges(spark, sf_dir), project="no such project")[0].select("id", "score")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, own AS (SELECT id FROM nodes WHERE kind = 'Project' AND upper(display_name) = 'ASIA'),
owned AS (SELECT n.* FROM nodes n WHERE owning_project_id IN (SELECT id FROM own) AND kind IN ('Project', 'Namespace', 'Type')), scored AS (
  SELECT id, 1000 AS score FROM own UNION ALL SELECT target_id, 850 FROM edges WHERE kind = 'depends_on_project' AND source_id IN (SELECT id FROM own) UNION ALL SELECT source_id, 850 FROM edges WHERE kind = 'depends_on_project' AND target_id IN (SELECT id FROM own)
  UNION ALL SELECT id, {case('kind', schema.NODE_PRIORITY, 10)} FROM owned
  UNION ALL SELECT a.id, {case('a.kind', schema.NODE_PRIORITY, 10)} + 50 FROM nodes a WHERE a.kind = 'Solution' OR (a.kind IN ('Project', 'Namespace') AND a.owning_project_id IN (SELECT id FROM own))
), best AS (SELECT id, max(score) AS score FROM scored GROUP BY id)
SELECT id, score FROM nodes JOIN best USING (id) ORDER BY score DESC, {case('kind', schema.NODE_PRIORITY, 10)} DESC, upper(coalesce(project_name, '')), upper(coalesce(file_path, '')), upper(display_name), id LIMIT 60""")
def export_project(spark, sf_dir):
    """The slice of one project: its neighbours, namespaces and types."""
    return export.select(nodes(spark, sf_dir), edges(spark, sf_dir), project="asia", max_nodes=60)[0].select("id", "score")


@query("""
WITH src AS (SELECT p_partkey AS k, 'src/' || p_brand || '/Members.cs' AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM part)
SELECT 'private-method' AS kind, 'Do' || k AS name, path, line, 'identifier appears only in its declaration' AS evidence FROM src WHERE k % 3 = 0 AND NOT (k % 2 = 1 AND k + 1 IN (SELECT k FROM src))
UNION ALL SELECT 'internal-type', 'Kit' || k, path, line, 'type name appears only in its declaration' FROM src WHERE k % 3 = 2 AND NOT (k % 2 = 0 AND k - 1 IN (SELECT k FROM src))""")
def source_dead_code(spark, sf_dir):
    """Methods and static classes, one for each part, some of which another part's line uses (classes by a member); braces in strings."""
    k = F.col("p_partkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("private void Do"), k, F.lit("() { }")))
        .when(k % 3 == 2, F.concat(F.lit("internal static class Kit"), k, F.lit(' { const string End = "}"; public static int Get'), k, F.lit("(int n) { return n; } }")))
        .otherwise(F.when(k % 2 == 0, F.concat(F.lit("Do"), k - 1, F.lit("();"))).otherwise(F.concat(F.lit("Get"), k + 1, F.lit("(1);"))))
    )
    rows = read(spark, sf_dir, "part").select("p_brand", F.struct("p_partkey", text.alias("text")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.text), "\n")  # a file is one row by nature
    return facts.dead_code(rows.groupBy("p_brand").agg(whole.alias("content")).select(F.concat(F.lit("src/"), "p_brand", F.lit("/Members.cs")).alias("path"), "content"))
