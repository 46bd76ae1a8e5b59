"""Graph operators on small literal graphs, with cycles, diamonds and dangling edges."""

import itertools
import random

from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import closure, graph
from graphloom.sources import snapshot


def edges_of(spark, rows):
    return spark.createDataFrame(rows, schema.EDGES)


def node(id_, kind="Type", name=None, project="p", path=None, doc=None, meta=None):
    return (id_, kind, name or id_, project, f"project:{project}", path, 1, 1, doc, meta)


def test_incremental_refresh_rebuilds_dependents(spark):
    depends = edges_of(spark, [("depends_on_project", "App", "Core"), ("depends_on_project", "Tests", "App")])
    changed = spark.createDataFrame([("Core",)], "id string")
    assert {r.id for r in closure.stale_projects(changed, depends).collect()} == {"Core", "App", "Tests"}
    assert closure.stale_projects(changed.limit(0), depends).count() == 0


def test_closure_against_brute_force_with_cycles(spark):
    random.seed(4)
    pairs = {(str(random.randrange(12)), str(random.randrange(12))) for _ in range(20)} | {("0", "1"), ("1", "2"), ("2", "0")}
    got = {r.id: r.depth for r in closure.reachable(spark.createDataFrame(list(pairs), "source_id string, target_id string"), spark.createDataFrame([("0",)], "id string")).collect()}
    want, frontier = {"0": 0}, ["0"]
    for depth in itertools.count(1):
        frontier = sorted({t for s, t in pairs if s in frontier} - want.keys())
        if not frontier:
            break
        want |= dict.fromkeys(frontier, depth)
    assert got == want


def test_changed_states(spark):
    cols = "project_id string, fingerprint string"
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], cols)
    before = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "9")], cols)
    assert {r.project_id for r in closure.changed_states(now, before).collect()} == {"b", "c"}


def test_dangling_edges_drop(spark):
    nodes = spark.createDataFrame([node("a"), node("b")], schema.NODES)
    links = edges_of(spark, [("calls", "a", "b"), ("calls", "missing", "b")])
    seeds = spark.createDataFrame([("b",)], "id string")
    assert [r.id for r in graph.neighbors(links, nodes, seeds, ["calls"], True).collect()] == ["a"]


def test_qualified_match_prefers_identity(spark):
    rows = [node("1", name="Thing", doc="T:A.Thing", meta="A.Thing"), node("2", name="ThingTests", doc="T:A.ThingTests", meta="A.ThingTests")]
    nodes = spark.createDataFrame(rows, schema.NODES)
    assert [r.id for r in graph.preferred(graph.ranked_symbols(nodes, "A.Thing", 12)).collect()] == ["1"]


def test_top_per_key_reports_what_it_leaves_out(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 1)], "k string, v int")
    got = {(r.k, r.v, r.place, r.total, r.truncated) for r in graph.top_per_key(df, ["k"], [F.col("v")], 2).collect()}
    assert got == {("x", 0, 1, 5, 3), ("x", 1, 2, 5, 3), ("y", 1, 1, 1, 0)}


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([(10, "u", 2), (11, "u", 5)], "rid int, k string, t int")
    assert {(r.id, r.found_id) for r in graph.as_of(left, right, "k", "t", "t", "rid").collect()} == {(1, 11), (2, None), (3, None)}
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 99)], "pos_id int, path string, pos int")
    spans = spark.createDataFrame([(1, "f", 0, 50, 0), (2, "f", 4, 6, 0), (3, "f", 4, 6, 1)], "range_id int, path string, first int, last int, rank int")
    assert {(r.pos_id, r.range_id) for r in graph.deepest_enclosing(points, spans).collect()} == {(1, 3)}


def test_longest_prefix_needs_whole_segments(spark):
    items = spark.createDataFrame([(1, "/w/app2/x.cs"), (2, "/w/app/sub/x.cs")], "item_id int, path string")
    owners = spark.createDataFrame([("a", "/w/app"), ("s", "/w/app/sub/")], "owner_id string, directory string")
    assert {(r.item_id, r.owner_id) for r in graph.longest_prefix(items, owners).collect()} == {(2, "s")}


def test_snapshot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([node("a", doc="di|Scoped|IFoo|Foo|factory|single")], schema.NODES)
    links = edges_of(spark, [("calls", "a", "a")])
    states = spark.createDataFrame([("p", "p", "p.proj", "f", ["q"])], schema.PROJECT_STATES)
    snapshot.write_snapshot({"nodes": nodes, "edges": links, "project_states": states}, f"{tmp_path}/s")
    read = snapshot.read_snapshot(spark, f"{tmp_path}/s")
    assert read["nodes"].collect() == nodes.collect() and read["edges"].collect() == links.collect() and read["project_states"].collect() == states.collect()
    assert snapshot.read_snapshot(spark, f"{tmp_path}/none") is None
    assert snapshot.unpacked(nodes).first() == ("a", "Scoped", "IFoo", "Foo", True, False)
    (tmp_path / "j.json").write_text('{"nodes": [{"id": "a", "kind": "Type", "displayName": "A", "projectName": "p"}], "edges": [{"kind": "calls", "sourceId": "a", "targetId": "b"}]}')
    got = snapshot.read_json_snapshot(spark, f"{tmp_path}/j.json")
    assert got["nodes"].first().display_name == "A" and got["edges"].first().target_id == "b" and got["project_states"].count() == 0
