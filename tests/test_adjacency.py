"""Edges stored in both directions: equal to the joins over all edges, and how little a lookup may read."""

import random

import pyarrow.parquet as pq

from graphloom import schema
from graphloom.operators import adjacency, graph
from graphloom.plans.workspace import Workspace


def tables(spark):
    rng = random.Random(2)
    ids = [f"n{i:05d}" for i in range(3000)]
    rows = [(rng.choice(["calls", "implements", "contains"]), rng.choice(ids), rng.choice(ids[:2500])) for _ in range(6000)]
    rows += [("calls", i, "n00007") for i in ids[:2000]] + [rows[0], ("calls", None, "n1"), ("calls", "gone", "n00003")]  # a hub, a repeated edge
    nodes = spark.createDataFrame([(i, "Method", i, "P", "p", "f.cs", 1, 1, None, None) for i in ids], schema.NODES)
    return nodes, spark.createDataFrame(rows, schema.EDGES)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_lookups(spark, tmp_path, monkeypatch):
    nodes, edges = tables(spark)
    path = f"file://{tmp_path}/adjacency"
    adjacency.store(edges, path, group_bytes=4096)
    few = spark.createDataFrame([("n00007",), ("n00007",), ("n01500",), ("nowhere",), (None,)], "id string")
    many = spark.createDataFrame([(f"n{i:05d}",) for i in range(0, 900, 25)], "id string")
    for most in (adjacency.MOST_SEEDS, 5):  # as a filter and as a join
        monkeypatch.setattr(adjacency, "MOST_SEEDS", most)
        for seeds in (few, many, few.limit(0)):
            for incoming in (True, False):
                same(adjacency.neighbors(path, nodes, seeds, ["calls", "implements"], incoming), graph.neighbors(edges, nodes, seeds, ["calls", "implements"], incoming))


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    _, edges = tables(spark)
    path = f"file://{tmp_path}/adjacency"
    adjacency.store(edges, path, group_bytes=4096)
    found = adjacency.edges_at(spark, path, spark.createDataFrame([("n01500",)], "id string"), ["calls"], incoming=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "target_id,n01500" in plan.replace(" ", "").replace("[", "").replace("(", ",") and "PartitionFilters: [" in plan
    held, every = 0, 0
    for file in (tmp_path / "adjacency" / "target_id").glob("kind=calls/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "target_id")
            every, held = every + 1, held + (column.statistics.min <= "n01500" <= column.statistics.max)
    assert every >= 4 and held <= 1 + every // 4


def test_workspace_looks_up_stored_edges(spark, tmp_path):
    nodes, edges = tables(spark)
    ws = Workspace(nodes=nodes, edges=edges)
    want = [ws.call_hierarchy("n00003"), ws.implementations("n00007"), ws.type_hierarchy("n00011")]
    ws.store_edges(f"file://{tmp_path}/own")
    for got, plain in zip([ws.call_hierarchy("n00003"), ws.implementations("n00007"), ws.type_hierarchy("n00011")], want):
        same(got, plain)


def test_change_impact_from_stored_edges(spark, tmp_path):
    nodes, edges = tables(spark)
    path = f"file://{tmp_path}/impact"
    adjacency.store(edges, path)
    stored, ids = adjacency.Stored(spark, path), spark.createDataFrame([("n00003",), ("n00007",), ("n00003",)], "id string")
    for f in (graph.call_seeds, graph.owning_types, graph.related_symbols):
        same(f(nodes, stored, ids), f(nodes, edges, ids))
    same(graph.neighbors(stored, nodes, ids, ["calls"], True), graph.neighbors(edges, nodes, ids, ["calls"], True))
    ws = Workspace(nodes=nodes, edges=edges)
    want = sorted(map(str, ws.impact_sections("n00003").collect()))
    ws.store_edges(f"file://{tmp_path}/own")
    assert sorted(map(str, ws.impact_sections("n00003").collect())) == want
    scans = ws.impact_sections("n00003")._jdf.queryExecution().executedPlan().toString()
    assert "target_id" in scans and str(tmp_path) in scans


def test_impact_callers_read_row_groups_of_their_seeds(spark):
    from graphloom.queries.graph import QUERIES

    plan = QUERIES["impact_callers_stored"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "edges-by-end" in plan and ("In(target_id" in plan.replace(" ", "") or "EqualTo(target_id" in plan)
