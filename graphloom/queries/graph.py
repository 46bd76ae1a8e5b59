"""Graph queries: counts, joins, closures, ranking, slices and change impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import scores
from ..operators import closure, graph, intervals, trigrams
from ..plans import change, impact, steps
from ..sources.tables import GRAPH_SQL, edges, nodes, read, stored_edges
from ..storage import fresh_path, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TARGET = "Customer#000000010"  # a type of every scale
NODE_ORDER = "upper(coalesce(file_path, '')), coalesce(line, 2147483647), id"


def query(sql: str | None = None, graph_tables: bool = True):
    """Registers a query under its function's name; sql may begin with more common tables, "name AS (...), ... SELECT"."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {GRAPH_SQL}{sql}" if graph_tables else sql
        return f

    return add


def case(column: str, table: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


@query(" SELECT 'node' AS of_what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def graph_kind_counts(spark, sf_dir):
    n = graph.kind_counts(nodes(spark, sf_dir)).withColumn("of_what", F.lit("node"))
    return n.unionByName(graph.kind_counts(edges(spark, sf_dir)).withColumn("of_what", F.lit("edge")))


@query(""" SELECT owning_project_id, count(*) FILTER (kind = 'Document') AS documents, count(*) FILTER (kind NOT IN ('Solution', 'Project', 'Document', 'DiRegistration', 'Entrypoint')) AS symbols
FROM nodes WHERE owning_project_id IS NOT NULL GROUP BY owning_project_id""")
def graph_owner_counts(spark, sf_dir):
    return graph.owner_counts(nodes(spark, sf_dir))


def _seeds(df):
    return df.where("kind = 'Type'").select("id")


@query(""" SELECT e.kind AS edge_kind, e.target_id AS seed_id, n.id, n.display_name FROM edges e JOIN nodes n ON n.id = e.source_id
WHERE e.kind IN ('inherits', 'contains') AND e.target_id IN (SELECT id FROM nodes WHERE kind = 'Type')""")
def neighbors_in(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.neighbors(edges(spark, sf_dir), n, _seeds(n), ["inherits", "contains"], True).select("edge_kind", "seed_id", "id", "display_name")


@query(""" SELECT e.kind AS edge_kind, e.source_id AS seed_id, n.id, n.display_name FROM edges e JOIN nodes n ON n.id = e.target_id
WHERE e.kind IN ('inherits', 'implements') AND e.source_id IN (SELECT id FROM nodes WHERE kind = 'Type')""")
def neighbors_out(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.neighbors(edges(spark, sf_dir), n, _seeds(n), ["inherits", "implements"], False).select("edge_kind", "seed_id", "id", "display_name")


@query(""" SELECT e.source_id AS parent_id, n.kind, count(*) AS children, min(n.id) AS first_child FROM edges e JOIN nodes n ON n.id = e.target_id
WHERE e.kind = 'contains' GROUP BY e.source_id, n.kind""")
def contained_children(spark, sf_dir):
    own = edges(spark, sf_dir).where("kind = 'contains'").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("id"))
    return own.join(nodes(spark, sf_dir).select("id", "kind"), "id").groupBy("parent_id", "kind").agg(F.count("*").alias("children"), F.min("id").alias("first_child"))


@query(f""", up AS (
  SELECT target_id AS id, source_id AS above, 1 AS depth FROM edges WHERE kind = 'contains' AND target_id IN (SELECT id FROM nodes WHERE kind = 'Method')
  UNION SELECT up.id, e.source_id, up.depth + 1 FROM up JOIN edges e ON e.target_id = up.above AND e.kind = 'contains'
) SELECT up.above AS id, CAST(min(depth) AS INT) AS depth, max({case('n.kind', schema.NODE_PRIORITY, 10)} + 50) AS score FROM up JOIN nodes n ON n.id = up.above GROUP BY up.above""")
def ancestors(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return closure.ancestors(n, edges(spark, sf_dir), n.where("kind = 'Method'").select("id"))


@query(""", held AS (
  SELECT target_id AS id, source_id AS above, 1 AS depth FROM edges WHERE kind = 'contains'
  UNION SELECT held.id, e.source_id, held.depth + 1 FROM held JOIN edges e ON e.target_id = held.above AND e.kind = 'contains'
), ids AS (SELECT source_id AS id FROM edges WHERE kind = 'contains' UNION SELECT target_id FROM edges WHERE kind = 'contains')
SELECT ids.id, coalesce(d.depth, 0) AS depth, 1 + coalesce(b.n, 0) AS size FROM ids LEFT JOIN (SELECT id, CAST(max(depth) AS BIGINT) AS depth FROM held GROUP BY id) d USING (id) LEFT JOIN (SELECT above AS id, count(*) AS n FROM held GROUP BY above) b USING (id)""")
def subtree_counts(spark, sf_dir):
    """Depth and subtree size of all that contains something or is contained."""
    return _containment(spark, sf_dir).select("id", "depth", "size")


@query(f""", up AS (
  SELECT target_id AS seed_id, source_id AS id, 1 AS distance FROM edges WHERE kind = 'contains' AND target_id IN (SELECT id FROM nodes WHERE display_name = '{TARGET}')
  UNION SELECT up.seed_id, e.source_id, up.distance + 1 FROM up JOIN edges e ON e.target_id = up.id AND e.kind = 'contains'
), down AS (
  SELECT source_id AS seed_id, target_id AS id, 1 AS distance FROM edges WHERE kind = 'contains' AND source_id IN (SELECT id FROM nodes WHERE display_name = 'EUROPE')
  UNION SELECT down.seed_id, e.target_id, down.distance + 1 FROM down JOIN edges e ON e.source_id = down.id AND e.kind = 'contains' WHERE down.distance < 2
) SELECT 'above' AS side, seed_id, id, CAST(distance AS BIGINT) AS distance FROM up UNION ALL SELECT 'below', seed_id, id, CAST(distance AS BIGINT) FROM down""")
def containment_ranges(spark, sf_dir):
    """What holds a type, and what a project holds down to two levels, from ranges of labels."""
    labels, n = _containment(spark, sf_dir), nodes(spark, sf_dir)
    up = intervals.above(labels, n.where(F.col("display_name") == TARGET)).withColumn("side", F.lit("above"))
    return up.unionByName(intervals.below(labels, n.where("display_name = 'EUROPE'"), 2).withColumn("side", F.lit("below")))


def _containment(spark, sf_dir):
    return intervals.label(edges(spark, sf_dir).where("kind = 'contains'").select(F.col("target_id").alias("id"), F.col("source_id").alias("parent_id")))


@query(""", closed AS (
  SELECT 'project:2' AS id UNION SELECT e.source_id FROM closed c JOIN edges e ON e.target_id = c.id AND e.kind = 'depends_on_project'
) SELECT id FROM closed""")
def stale_closure(spark, sf_dir):
    depends = edges(spark, sf_dir).where("kind = 'depends_on_project'")
    return closure.stale_projects(spark.range(1).select(F.lit("project:2").alias("id")), depends).select("id")


@query(""", walk AS (
  SELECT 'type:c:3' AS id, 0 AS depth UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id AND e.kind = 'inherits'
) SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id""")
def subtype_closure(spark, sf_dir):
    up = edges(spark, sf_dir).where("kind = 'inherits'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return closure.reachable(up, spark.range(1).select(F.lit("type:c:3").alias("id"))).groupBy("id").agg(F.min("depth").alias("depth"))


SEEDS_SQL = """, t AS (SELECT id, kind FROM nodes WHERE display_name = 'Customer#000000010'),
bases AS (SELECT target_id AS id FROM edges WHERE kind IN ('implements', 'inherits') AND source_id IN (SELECT id FROM t WHERE kind = 'Type')),
members AS (SELECT target_id AS id FROM edges WHERE kind = 'contains' AND source_id IN (SELECT id FROM t WHERE kind = 'Type')),
seeds AS (SELECT id FROM t UNION SELECT id FROM bases UNION SELECT id FROM members UNION SELECT target_id FROM edges WHERE kind = 'contains' AND source_id IN (SELECT id FROM bases))"""


@query(SEEDS_SQL + " SELECT id FROM seeds")
def call_seed_expansion(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.call_seeds(n, edges(spark, sf_dir), n.where(F.col("display_name") == TARGET).select("id"))


@query(""", f AS (SELECT id FROM nodes WHERE kind = 'Field' AND display_name = 'red bolt')
SELECT n.id, n.display_name, min(e.target_id) AS seed_id FROM edges e JOIN f ON f.id = e.target_id JOIN nodes n ON n.id = e.source_id WHERE e.kind = 'calls' GROUP BY n.id, n.display_name""")
def impact_callers(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    seeds = graph.call_seeds(n, e, n.where("kind = 'Field' and display_name = 'red bolt'").select("id"))
    callers = graph.neighbors(e, n, seeds, ["calls"], incoming=True)
    return graph.keep_first(callers, [F.col("id")], [F.col("seed_id")]).select("id", "display_name", "seed_id")


def impact_callers_stored(spark, sf_dir):
    """impact_callers from edges stored by both ends; each step's seeds are written, since a lookup counts them first."""
    n, e = nodes(spark, sf_dir), stored_edges(spark, sf_dir)
    fields = materialize(n.where("kind = 'Field' and display_name = 'red bolt'").select("id", "kind"), "fields")
    seeds = materialize(graph.call_seeds(n, e, fields), "call-seeds")
    callers = graph.neighbors(e, n, seeds, ["calls"], incoming=True)
    return graph.keep_first(callers, [F.col("id")], [F.col("seed_id")]).select("id", "display_name", "seed_id")


QUERIES["impact_callers_stored"], ORACLES["impact_callers_stored"] = impact_callers_stored, ORACLES["impact_callers"]


@query(""" SELECT e.kind AS edge_kind, n.documentation_id, min(n.id) AS id FROM edges e JOIN nodes n ON n.id = e.source_id
WHERE e.kind IN ('inherits', 'implements', 'overrides') AND e.target_id IN ('type:c:1', 'type:s:1', 'type:s:2') GROUP BY e.kind, n.documentation_id, n.file_path, n.line""")
def related_symbols(spark, sf_dir):
    seeds = spark.range(1).select(F.explode(F.array(F.lit("type:c:1"), F.lit("type:s:1"), F.lit("type:s:2"))).alias("id"))
    return graph.related_symbols(nodes(spark, sf_dir), edges(spark, sf_dir), seeds).select("edge_kind", "documentation_id", "id")


@query(f""" SELECT id, display_name, score, tier FROM (
  SELECT *, greatest(CASE WHEN documentation_id = q THEN 300 ELSE 0 END, CASE WHEN upper(payload) = upper(q) THEN 280 ELSE 0 END, CASE WHEN ends_with(upper(payload), upper(q)) THEN 240 ELSE 0 END,
    CASE WHEN contains(upper(payload), upper(q)) THEN 180 ELSE 0 END, CASE WHEN upper(metadata_name) = upper(q) THEN 160 ELSE 0 END, CASE WHEN contains(upper(metadata_name), upper(q)) THEN 120 ELSE 0 END,
    CASE WHEN upper(display_name) = upper(q) THEN 140 ELSE 0 END, CASE WHEN contains(upper(display_name), upper(q)) THEN 100 ELSE 0 END) AS score,
    CASE WHEN documentation_id = q OR upper(payload) = upper(q) THEN 0 WHEN upper(metadata_name) = upper(q) OR upper(display_name) = upper(q) THEN 1 ELSE 2 END AS tier
  FROM (SELECT *, 'Customer#00000001' AS q, regexp_replace(documentation_id, '^[^:]*:', '') AS payload FROM nodes WHERE kind NOT IN ('Solution', 'Project', 'Document', 'DiRegistration', 'Entrypoint'))
) WHERE score > 0 ORDER BY score DESC, upper(coalesce(project_name, '')), {NODE_ORDER} LIMIT 12""")
def symbol_match_rank(spark, sf_dir):
    return graph.ranked_symbols(nodes(spark, sf_dir), "Customer#00000001", 12).select("id", "display_name", "score", "tier")


def symbol_match_indexed(spark, sf_dir):
    """symbol_match_rank by postings of the trigrams of all names."""
    own, path, query_text = nodes(spark, sf_dir), fresh_path(spark, "names"), "Customer#00000001"
    trigrams.store(own, path, ["documentation_id", "metadata_name", "display_name"])
    return graph.ranked_symbols(trigrams.may_hold(spark, path, query_text), query_text, 12).select("id", "display_name", "score", "tier")


QUERIES["symbol_match_indexed"], ORACLES["symbol_match_indexed"] = symbol_match_indexed, ORACLES["symbol_match_rank"]


@query(""" SELECT id, display_name FROM nodes WHERE kind = 'Type' AND display_name = 'Customer#000000010'""")
def preferred_tier(spark, sf_dir):
    """The display name matches one node by name; longer names that hold it fall behind."""
    return graph.preferred(graph.ranked_symbols(nodes(spark, sf_dir), TARGET, 12)).select("id", "display_name")


@query("""
WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS name, p_brand || '.' || p_type AS container, 'src/' || p_type || CASE WHEN p_size % 5 = 0 THEN '/tests/' ELSE '/' END || p_partkey || '.src' AS path FROM part)
SELECT p_partkey, name, CAST(score AS INT) AS score FROM (
  SELECT *, CASE WHEN container || '.' || name = 'ECONOMY.ring' THEN 1000 WHEN upper(container || '.' || name) = 'ECONOMY.RING' THEN 950 WHEN ends_with(upper(container || '.' || name), 'ECONOMY.RING') THEN 700 ELSE 0 END
    + CASE WHEN name = 'ECONOMY.ring' THEN 700 ELSE 0 END + CASE WHEN name = 'ring' THEN 600 WHEN upper(name) = 'RING' THEN 550 ELSE 0 END
    + CASE WHEN container = 'ECONOMY' THEN 500 WHEN upper(container) = 'ECONOMY' THEN 475 WHEN ends_with(upper(container), 'ECONOMY') THEN 300 ELSE 0 END
    + CASE WHEN regexp_matches(path, '(?i)ECONOMY[./]ring') THEN 400 ELSE 0 END - CASE WHEN contains(path, '/tests/') THEN 100 ELSE 0 END AS score
  FROM s) WHERE score > 0""", graph_tables=False)
def symbol_search_score(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    folder = F.when(F.col("p_size") % 5 == 0, "/tests/").otherwise("/")
    s = p.select("p_partkey", F.split("p_name", " ")[1].alias("name"), F.concat("p_brand", F.lit("."), "p_type").alias("container"), F.concat(F.lit("src/"), "p_type", folder, F.col("p_partkey").cast("string"), F.lit(".src")).alias("path"))
    return s.withColumn("score", scores.symbol_search_score("ECONOMY.ring", F.col("name"), F.col("container"), F.col("path")).cast("int")).where("score > 0").select("p_partkey", "name", "score")


def _sections(spark, sf_dir):
    """Three sections that name files: customers as callers, suppliers as registrations, both again as relations of odd keys."""
    n = nodes(spark, sf_dir).where("kind = 'Type'")
    own = n.select("file_path", F.when(F.col("id").startswith("type:c"), "caller").otherwise("registration").alias("section"))
    rows = own.unionByName(n.where("id like '%1'").select(F.upper("file_path").alias("file_path"), F.lit("relation").alias("section")))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in impact.WEIGHTS.items() for x in pair]), F.col("section"))
    return rows.select(F.col("file_path").alias("path"), "section", weight.alias("weight"))


@query(""", s AS (
  SELECT file_path AS path, CASE WHEN id LIKE 'type:c%' THEN 'caller' ELSE 'registration' END AS section, CASE WHEN id LIKE 'type:c%' THEN 80 ELSE 60 END AS weight FROM nodes WHERE kind = 'Type'
  UNION ALL SELECT upper(file_path), 'relation', 70 FROM nodes WHERE kind = 'Type' AND id LIKE '%1'
) SELECT min(path) AS path, CAST(sum(weight) AS BIGINT) AS score, string_agg(DISTINCT section, ',' ORDER BY section) AS reasons FROM s GROUP BY upper(path)""")
def file_score_rollup(spark, sf_dir):
    return graph.file_scores(_sections(spark, sf_dir))


@query(""", s AS (
  SELECT e.source_id AS id, CASE e.kind WHEN 'inherits' THEN 800 WHEN 'contains' THEN 850 ELSE 800 END AS score, e.kind AS reason, CASE e.kind WHEN 'inherits' THEN 0 WHEN 'contains' THEN 1 ELSE 2 END AS seq FROM edges e
) SELECT id, max(score) AS score, arg_max(reason, score * 10 - seq) AS reason FROM s GROUP BY id""")
def max_score_reason(spark, sf_dir):
    e = edges(spark, sf_dir)
    seq = F.when(F.col("kind") == "inherits", 0).when(F.col("kind") == "contains", 1).otherwise(2)
    return graph.max_score_reason(e.select(F.col("source_id").alias("id"), F.when(F.col("kind") == "contains", 850).otherwise(800).alias("score"), F.col("kind").alias("reason"), seq.alias("seq")))


@query(""" SELECT e.kind, e.source_id, e.target_id FROM edges e
WHERE e.source_id IN (SELECT id FROM nodes WHERE owning_project_id = 'project:1') AND e.target_id IN (SELECT id FROM nodes WHERE owning_project_id = 'project:1')""")
def edges_within(spark, sf_dir):
    return graph.edges_within(edges(spark, sf_dir), nodes(spark, sf_dir).where("owning_project_id = 'project:1'"))


SLICE_SQL = f""", scored AS (
  SELECT id, max(score) AS score FROM (
    SELECT id, 1000 AS score FROM nodes WHERE id = 'type:c:5' UNION ALL SELECT source_id, 800 FROM edges WHERE kind IN ('inherits', 'contains') AND target_id = 'type:c:5'
    UNION ALL SELECT target_id, 800 FROM edges WHERE kind IN ('inherits', 'contains') AND source_id = 'type:c:5') GROUP BY id
), top AS (
  SELECT n.*, score FROM nodes n JOIN scored USING (id)
  ORDER BY score DESC, {case('kind', schema.NODE_PRIORITY, 10)} DESC, upper(coalesce(project_name, '')), upper(coalesce(file_path, '')), upper(display_name), id LIMIT 15
), numbered AS (
  SELECT *, 'n' || (row_number() OVER (ORDER BY score DESC, {case('kind', schema.NODE_PRIORITY, 10)} DESC, upper(coalesce(project_name, '')), upper(coalesce(file_path, '')), upper(display_name), id) - 1) AS graph_id FROM top
)"""


def _slice(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    focus = n.where("id = 'type:c:5'")
    scored = focus.select("id", F.lit(1000).alias("score"), F.lit("focus").alias("reason"), F.lit(0).alias("seq"))
    for incoming in (True, False):
        near = graph.neighbors(e, n, focus, ["inherits", "contains"], incoming)
        scored = scored.unionByName(near.select("id", F.lit(800).alias("score"), F.col("edge_kind").alias("reason"), F.lit(1).alias("seq")))
    return graph.select_slice(scored, n, e, 15, 30)


@query(SLICE_SQL + " SELECT graph_id, id, score FROM numbered")
def slice_topn_nodes(spark, sf_dir):
    return _slice(spark, sf_dir)[0].select("graph_id", "id", "score")


@query(SLICE_SQL + f""" SELECT kind, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)
ORDER BY {case('kind', schema.EDGE_PRIORITY, 10)} DESC, kind, source_id, target_id LIMIT 30""")
def slice_topn_edges(spark, sf_dir):
    return _slice(spark, sf_dir)[1].select("kind", "source_id", "target_id")


@query(SLICE_SQL + f""", e AS (
  SELECT x.kind, s.graph_id AS source, t.graph_id AS target, {case('x.kind', schema.EDGE_PRIORITY, 10)} AS p, source_id, target_id FROM edges x JOIN numbered s ON s.id = x.source_id JOIN numbered t ON t.id = x.target_id ORDER BY p DESC, x.kind, source_id, target_id LIMIT 30
) SELECT 'flowchart LR' || chr(10) || (SELECT string_agg('  ' || graph_id || '["' || kind || ': ' || display_name || '"]', chr(10) ORDER BY CAST(substr(graph_id, 2) AS INT)) FROM numbered) || chr(10)
  || (SELECT string_agg('  ' || source || ' -->|' || kind || '| ' || target, chr(10) ORDER BY p DESC, kind, source_id, target_id) FROM e) || chr(10)
  || (SELECT string_agg('  class ' || graph_id || ' ' || CASE WHEN kind IN ('Solution', 'Project', 'Namespace', 'Type', 'Document', 'Entrypoint') THEN lower(kind) ELSE 'member' END || ';', chr(10) ORDER BY CAST(substr(graph_id, 2) AS INT)) FROM numbered) AS text""")
def graph_render_mermaid(spark, sf_dir):
    from ..operators import render

    return render.mermaid(*_slice(spark, sf_dir))


@query(""" SELECT DISTINCT id, 850 AS score FROM (
  SELECT target_id AS id FROM edges WHERE kind = 'depends_on_project' AND source_id = 'project:0' UNION ALL SELECT source_id FROM edges WHERE kind = 'depends_on_project' AND target_id = 'project:0')""")
def project_neighbors(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.project_neighbors(edges(spark, sf_dir), n, n.where("id = 'project:0'"))


@query(""" SELECT id, kind, display_name || CASE WHEN kind = 'Type' AND id LIKE '%5' THEN ' (new)' ELSE '' END AS display_name FROM nodes""")
def node_upsert(spark, sf_dir):
    """All nodes, with types of keys that end in 5 renamed by a later batch."""
    n = nodes(spark, sf_dir).select("id", "kind", "display_name")
    return graph.upsert_nodes(n, n.where("kind = 'Type' and id like '%5'").withColumn("display_name", F.concat("display_name", F.lit(" (new)"))))


@query("""
WITH st AS (SELECT 'p' || o_custkey AS project_id, 'c' || o_custkey AS name, o_orderkey || '|' || o_orderstatus || '|' || CAST(o_totalprice * 100 AS BIGINT) AS line, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders)
SELECT project_id, sha256(min(name) || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM st GROUP BY project_id HAVING bool_or(late)""", graph_tables=False)
def changed_state(spark, sf_dir):
    """Customers as projects, their orders as files: which fingerprints changed since 1998 began."""
    from ..sources.text import fingerprints

    o = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("modified"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), (F.col("o_orderdate") >= "1998-01-01").alias("late"),
    )
    return closure.changed_states(fingerprints(o), fingerprints(o.where("not late"))).select("project_id", "fingerprint")


@query(""" SELECT id, kind, CASE WHEN owning_project_id IN ('project:0', 'project:1', 'project:2', 'project:3') THEN display_name || '*' ELSE display_name END AS display_name, owning_project_id FROM nodes WHERE owning_project_id IS NOT NULL""")
def incremental_merge(spark, sf_dir):
    """Project 2 changed: it and its dependents are rebuilt (names get a mark), the rest is reused."""
    n = nodes(spark, sf_dir).where("owning_project_id is not null").select("id", "kind", "display_name", "owning_project_id")
    stale = closure.stale_projects(spark.range(1).select(F.lit("project:2").alias("id")), edges(spark, sf_dir).where("kind = 'depends_on_project'"))
    rebuilt = n.join(stale.select(F.col("id").alias("owning_project_id")), "owning_project_id", "left_semi").withColumn("display_name", F.concat("display_name", F.lit("*")))
    return closure.merged_snapshot(n, rebuilt, stale, "owning_project_id", ["id"]).select("id", "kind", "display_name", "owning_project_id")


IMPACT_SQL = SEEDS_SQL + f""",
reach AS (SELECT id FROM t UNION SELECT target_id FROM edges WHERE kind IN ('implements', 'inherits', 'overrides') AND source_id IN (SELECT id FROM t)),
holders AS (SELECT id FROM reach UNION SELECT e.source_id FROM edges e JOIN nodes n ON n.id = e.source_id AND n.kind = 'Type' WHERE e.kind = 'contains' AND e.target_id IN (SELECT id FROM reach)),
found AS (
  SELECT DISTINCT 'target' AS section, n.id, n.file_path, n.line FROM nodes n WHERE n.id IN (SELECT id FROM t)
  UNION ALL SELECT DISTINCT 'caller', n.id, n.file_path, n.line FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.kind = 'calls' AND e.target_id IN (SELECT id FROM seeds)
  UNION ALL SELECT DISTINCT 'relation', n.id, n.file_path, n.line FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.kind IN ('inherits', 'implements', 'overrides') AND e.target_id IN (SELECT id FROM holders)
  UNION ALL SELECT DISTINCT 'registration', n.id, n.file_path, n.line FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.kind IN ('registered_as', 'consumed_by') AND e.target_id IN (SELECT id FROM holders)
), pages AS (
  SELECT *, row_number() OVER (PARTITION BY section ORDER BY {NODE_ORDER}) AS place, count(*) OVER (PARTITION BY section) AS total FROM found
), cut AS (SELECT section, CAST(place AS INT) AS place, id, file_path AS path, line, total FROM pages WHERE place <= 20)"""


@query(IMPACT_SQL + " SELECT section, place, id, path, line, total FROM cut")
def change_impact_sections(spark, sf_dir):
    return impact.sections(nodes(spark, sf_dir), edges(spark, sf_dir), TARGET)


@query(IMPACT_SQL + """ SELECT min(path) AS path, CAST(sum(CASE section WHEN 'target' THEN 100 WHEN 'caller' THEN 80 WHEN 'relation' THEN 70 ELSE 60 END) AS BIGINT) AS score, string_agg(DISTINCT section, ',' ORDER BY section) AS reasons
FROM cut WHERE coalesce(trim(path), '') <> '' GROUP BY upper(path) ORDER BY score DESC, upper(min(path)), min(path) LIMIT 20""")
def change_impact(spark, sf_dir):
    return impact.change_impact(nodes(spark, sf_dir), edges(spark, sf_dir), TARGET)


@query(IMPACT_SQL + """, firsts AS (
  SELECT section, path, place FROM (SELECT *, row_number() OVER (PARTITION BY section, upper(path) ORDER BY place, path) AS k FROM cut WHERE coalesce(trim(path), '') <> '') WHERE k = 1
), tops AS (SELECT section, path, row_number() OVER (PARTITION BY section ORDER BY place, path) AS k FROM firsts)
SELECT CAST(row_number() OVER (ORDER BY CASE section WHEN 'target' THEN 0 WHEN 'caller' THEN 1 WHEN 'relation' THEN 2 ELSE 3 END) AS INT) AS step,
  CASE section WHEN 'target' THEN 'Inspect primary change targets' WHEN 'caller' THEN 'Inspect direct callers' WHEN 'relation' THEN 'Inspect inheritance and override surfaces' ELSE 'Inspect runtime wiring' END AS title, files
FROM (SELECT section, string_agg(path, ',' ORDER BY k) AS files FROM tops WHERE k <= 10 GROUP BY section)""")
def plan_change(spark, sf_dir):
    return change.plan_steps(impact.sections(nodes(spark, sf_dir), edges(spark, sf_dir), TARGET))


@query(IMPACT_SQL + """, files AS (SELECT section, path, place, CASE section WHEN 'target' THEN 0 WHEN 'caller' THEN 1 WHEN 'relation' THEN 2 ELSE 3 END AS n FROM cut WHERE coalesce(trim(path), '') <> ''),
prim AS (SELECT min(upper(path)) AS key FROM files WHERE n = 0 GROUP BY upper(path) ORDER BY min(place) LIMIT 10),
steps AS (
  SELECT 'inspect' AS phase, n, path, n AS arm, place FROM files
  UNION ALL SELECT 'edit', 0, path, 0, place FROM files WHERE n = 0
  UNION ALL SELECT 'edit', 1, path, n, place FROM files WHERE n IN (1, 2) AND upper(path) NOT IN (SELECT key FROM prim)
), firsts AS (SELECT *, row_number() OVER (PARTITION BY phase, n, upper(path) ORDER BY arm, place, path) AS k FROM steps),
tops AS (SELECT *, row_number() OVER (PARTITION BY phase, n ORDER BY arm, place, path) AS r, count(*) OVER (PARTITION BY phase, n) AS total FROM firsts WHERE k = 1),
second AS (SELECT upper(path) AS key FROM tops WHERE phase = 'edit' AND n = 1 AND r <= 10),
wires AS (SELECT path, place, row_number() OVER (PARTITION BY upper(path) ORDER BY place, path) AS k FROM files WHERE n = 3 AND upper(path) NOT IN (SELECT key FROM prim) AND upper(path) NOT IN (SELECT key FROM second)),
every AS (
  SELECT phase, n, path, r, total FROM tops
  UNION ALL SELECT 'edit', 2, path, row_number() OVER (ORDER BY place, path), count(*) OVER () FROM wires WHERE k = 1
)
SELECT phase, CAST(row_number() OVER (PARTITION BY phase ORDER BY n) AS INT) AS step, files, truncated FROM (
  SELECT phase, n, string_agg(path, ',' ORDER BY r) AS files, CAST(greatest(max(total) - 10, 0) AS BIGINT) AS truncated FROM every WHERE r <= 10 GROUP BY phase, n)""")
def plan_steps_of_phases(spark, sf_dir):
    """The steps that inspect and edit, of the flagship's target, with how many files are left out of each."""
    found = materialize(impact.sections(nodes(spark, sf_dir), edges(spark, sf_dir), TARGET), "impact")
    projects = nodes(spark, sf_dir).where("kind = 'Project'").select(F.col("id").alias("project_id"), F.col("display_name").alias("project_name"), F.col("file_path").alias("path"), F.lit(False).alias("is_test"))
    return steps.inspect_and_edit(found, projects).select("phase", "step", F.array_join("targets", ",").alias("files"), "truncated")
