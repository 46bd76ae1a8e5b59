"""Interval labels against a plain walk over the parents, and what they answer."""

import random

import pytest

from graphloom.operators import intervals

KIND = "id string, parent_id string"


def forest():
    rng = random.Random(9)
    rows = [(f"n{i}", f"n{rng.randrange(max(0, i - 8), i)}" if i % 40 else None) for i in range(120)]
    rows += [(f"deep{i}", f"deep{i - 1}") for i in range(1, 70)]  # deep0 is a parent only
    rows += [(f"leaf{i}", "n3") for i in range(60)] + [rows[5], (None, "n1"), ("two", "n9"), ("two", "n4"), ("two", None)]
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("under", "c2"), ("under it", "under"), ("self", "self")]
    return rows


def parents(rows):
    out = {}
    for child, parent in rows:
        if child is not None:
            out.setdefault(child, set()).add(parent)
            if parent is not None:
                out.setdefault(parent, set())
    return {c: min(p - {None}, default=None) for c, p in out.items()}


def way(up, node):
    out = []
    while up[node] is not None and len(out) <= len(up):
        node = up[node]
        out.append(node)
    return out


@pytest.mark.parametrize("piece", [intervals.PIECE_ROWS, 7])
def test_against_a_walk(spark, monkeypatch, piece):
    monkeypatch.setattr(intervals, "PIECE_ROWS", piece)
    up = parents(forest())
    labels = intervals.label(spark.createDataFrame(forest(), KIND))
    got = {r.id: r for r in labels.collect()}
    assert set(got) == set(up) and labels.count() == len(up)
    ways = {n: way(up, n) for n in up}
    cyclic = {n for n in up if len(ways[n]) > len(up)}
    assert cyclic == {n for n, r in got.items() if r.in_cycle} == {"c1", "c2", "c3", "under", "under it", "self"}
    assert all(got[n].pre is got[n].post is got[n].depth is got[n].size is None for n in cyclic)
    fine = set(up) - cyclic
    for n in fine:
        assert got[n].depth == len(ways[n]) and got[n].size == 1 + sum(n in ways[m] for m in fine)
        assert {m for m in fine if got[n].pre < got[m].pre <= got[n].post} == {m for m in fine if n in ways[m]}
    assert sorted(got[n].pre for n in fine) == list(range(len(fine)))
    assert got["two"].parents == 2 and got["two"].parent_id == "n4" and got["deep0"].parents == 0

    seeds = spark.createDataFrame([("deep40",), ("leaf3",), ("leaf3",), ("c1",), ("nowhere",), (None,)], "id string")
    want = {(s, a, i + 1) for s in ("deep40", "leaf3") for i, a in enumerate(ways[s])}
    assert {tuple(r) for r in intervals.above(labels, seeds).collect()} == want
    tops = spark.createDataFrame([("deep40",), ("n3",)], "id string")
    held = {(s, m, ways[m].index(s) + 1) for s in ("deep40", "n3") for m in fine if s in ways[m]}
    assert {tuple(r) for r in intervals.below(labels, tops).collect()} == held
    assert {tuple(r) for r in intervals.below(labels, tops, 2).collect()} == {h for h in held if h[2] <= 2}
    assert intervals.above(labels, seeds.where("false")).isEmpty()
    plan = intervals.above(labels, seeds)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert intervals.label(spark.createDataFrame([], KIND)).isEmpty()


def test_many_seeds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(intervals, "MOST_SEEDS", 2)
    labels = intervals.label(spark.createDataFrame(forest(), KIND))
    with pytest.raises(ValueError, match="seeds"):
        intervals.above(labels, labels)


def test_workspace(spark):
    from graphloom import schema
    from graphloom.plans.workspace import Workspace

    nodes = spark.createDataFrame([(i, "Type", i, "P", "p", "f.cs", 1, 1, None, None) for i in "abcd"], schema.NODES)
    edges = spark.createDataFrame([("contains", "a", "b"), ("contains", "b", "c"), ("contains", "c", "d"), ("calls", "d", "a")], schema.EDGES)
    symbols = [("s1", None, "A", "Class", None, "f.cs", 1, 0, 9, 0), ("s2", "s1", "M", "Method", "A", "f.cs", 2, 0, 3, 0), ("s3", "s1", "N", "Method", "A", "f.cs", 4, 0, 5, 0), ("s4", None, "A", "Class", None, "g.cs", 1, 0, 9, 0)]
    ws = Workspace(nodes=nodes, edges=edges, symbols=spark.createDataFrame(symbols, schema.SYMBOLS))
    labels = ws.containment()
    assert [(r.id, r.distance) for r in ws.containers("c", labels).collect()] == [("b", 1), ("a", 2)]
    assert [(r.id, r.distance) for r in ws.contents("a", 2, labels).collect()] == [("b", 1), ("c", 2)]
    assert [(r.id, r.depth, r.descendants) for r in ws.symbol_tree("f.cs").collect()] == [("s1", 0, 2), ("s2", 1, 0), ("s3", 1, 0)]
