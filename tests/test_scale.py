"""Split keys and blocks give what the plain form gives."""

import random

from pyspark.sql import functions as F

from graphloom.operators import closure, diagnostics, facts, graph


def test_deepest_range_against_all_pairs(spark):
    random.seed(3)
    ranges = [(i, random.choice("ab"), a, a + random.choice([0, 1, 3, 40, 500]), i % 3) for i, a in enumerate(random.choices(range(1000), k=200))] + [(900, "a", 9, 3, 0)]
    positions = [(i, random.choice("abc"), random.randrange(1100)) for i in range(300)]
    want = {}
    for i, path, pos in positions:
        held = [(last - first, -rank, r) for r, p, first, last, rank in ranges if p == path and first <= pos <= last]
        if held:
            want[i] = min(held)[2]
    r = spark.createDataFrame(ranges, "range_id long, path string, first long, last long, rank int")
    p = spark.createDataFrame(positions, "pos_id long, path string, pos long")
    assert {x.pos_id: x.range_id for x in graph.deepest_enclosing(p, r).collect()} == want
    assert graph.deepest_enclosing(p, r.limit(0)).count() == 0


def test_as_of_in_pieces(spark, monkeypatch):
    random.seed(4)
    left = spark.createDataFrame([(i, i % 3, random.randrange(200)) for i in range(120)], "l long, k int, t long")
    right = spark.createDataFrame([(i, i % 4, random.randrange(200)) for i in range(90)], "r long, k int, t long")
    whole = sorted(map(tuple, graph.as_of(left, right, "k", "t", "t", "r").collect()))
    monkeypatch.setattr(graph, "AS_OF_ROWS", 9)
    assert sorted(map(tuple, graph.as_of(left, right, "k", "t", "t", "r").collect())) == whole


def test_reachable_takes_one_step_or_several(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(5, 2), (3, 9), (20, 21)], "source_id long, target_id long")
    seeds = spark.createDataFrame([(0,), (4,)], "id long")
    several = {(r.id, r.depth) for r in closure.reachable(edges, seeds).collect()}
    assert several == {(0, 0), (4, 0), (1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3), (8, 4), (9, 4), (10, 5), (11, 6)}
    assert {(r.id, r.depth) for r in closure.reachable(edges, seeds, 2).collect()} == {x for x in several if x[1] <= 2}
    monkeypatch.setattr(closure, "SMALL_LINKS", 0)
    assert {(r.id, r.depth) for r in closure.reachable(edges, seeds).collect()} == several


def test_best_types_against_all_pairs(spark):
    random.seed(6)
    names = ["Foo", "A.Foo", "B.A.Foo", "Bar", "a.foo", "Baz"]
    types = [(f"t{i}", m.split(".")[-1], m, random.choice("pq")) for i, m in enumerate(random.choices(names, k=25))]
    asked = [(i, n, p) for i, (n, p) in enumerate((n, p) for n in [*names, "Nothing", "x.Foo"] for p in "pqr")]
    want = {}
    for i, n, p in asked:
        scored = []
        for t, display, m, own in types:
            if display.upper() == n.split(".")[-1].upper():
                way = 300 if m == n else 260 if display == n else 180 if m.upper().endswith("." + n.upper()) else 170
                scored.append((-way - 20 * (own == p), t))
        if scored:
            s, t = min(scored)
            want[i] = (t, -s)
    t = spark.createDataFrame(types, "id string, display_name string, metadata_name string, project string")
    got = facts.best_types(spark.createDataFrame(asked, "reg_id int, type string, project string"), t)
    assert {r.reg_id: (r.id, r.score) for r in got.collect()} == want


def join_rows(df):
    """Rows that each join of the plan made in the df's last run."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = [node.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_registration_consumers_against_all_pairs(spark):
    random.seed(9)
    kinds = ["A.Foo", "B.Foo", "Foo", "A.Bar", "Baz", "", None]
    registered = [(random.choice([*range(40), None]), random.choice(kinds), random.choice(["p", "q", "", None])) for _ in range(60)] + [(50, "A.Only", "p"), (51, "Only", None), (52, "X.None", None)]
    kinds += ["Only", "A.Only", "None"]
    used = [(random.choice([*range(40), None]), random.choice(["p", "q", "", None]), [random.choice(["{}", "{}[]", "IList<{}>", "ILogger<{}>"]).format(random.choice(kinds)) for _ in range(random.randrange(4))]) for _ in range(80)]
    forms = {(r, p, n) for r, t, p in registered if t is not None for n in (t, t.split(".")[-1])}
    shared = {n: len({p for _, p, m in forms if m == n and p is not None}) for _, _, n in forms}
    bare = lambda x: x[:-2] if x.endswith("[]") else x[6:-1] if x.startswith("IList<") and len(x) > 7 else x
    want = {(r, u) for u, own, types in used for x in types for r, p, n in forms if n == bare(x) and (shared[n] == 1 or (p is not None and p == own))}
    r = spark.createDataFrame(registered, "reg_id int, type string, project string")
    u = spark.createDataFrame(used, "use_id int, project string, parameter_types array<string>")
    got = [tuple(x) for x in facts.registration_consumers(r, u).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 100


def test_registration_consumers_make_no_pairs_beyond_the_result(spark):
    """One name in each of 20 projects: no join makes the pairs of different projects, which are 20 times as many as the results."""
    r = spark.range(400).select(F.col("id").alias("reg_id"), F.lit("A.Foo").alias("type"), (F.col("id") % 20).cast("string").alias("project"))
    u = r.select(F.col("reg_id").alias("use_id"), "project", F.array("type", F.lit("Foo[]")).alias("parameter_types"))
    found = facts.registration_consumers(r, u)
    assert len(found.collect()) == 400 * 20
    assert max(join_rows(found)) == 400 * 20


def test_lines_of_matches(spark):
    own = spark.createDataFrame([("a", "x\ny x\n\nx x"), ("b", None), ("c", "nothing")], "path string, content string")
    assert [(r.path, r.line, r.end) for r in facts.file_matches(own, "x", 0).orderBy("path", "end").collect()] == [("a", 1, 1), ("a", 2, 5), ("a", 4, 8), ("a", 4, 10)]
    assert "content" not in facts.file_matches(own, "x", 0).columns


def test_names_that_clash_with_those_inside(spark):
    own = spark.createDataFrame([("a", "Type", "x", 1, 7, 9), ("a", "Type", "y", 2, 8, 9)], "id string, kind string, display_name string, _n int, _batch int, key int")
    assert graph.keep_first(own, [F.col("id")], [F.col("_n")]).collect() == [own.first()]
    assert [tuple(r) for r in graph.upsert_nodes(own, own.where("_n = 2")).collect()] == [("a", "Type", "y", 2, 8, 9)]
    assert diagnostics.in_focus(own.withColumnRenamed("id", "uri"), spark.createDataFrame([("A",)], "path string")).count() == 2
