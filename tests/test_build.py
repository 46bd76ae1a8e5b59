"""Graph builds over small tables of compiler facts, whole and after a change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom import schema, storage
from graphloom.operators import build
from graphloom.plans.workspace import Workspace
from graphloom.queries import source
from graphloom.sources import snapshot
from oracle import SMALLEST

SYMBOLS = "symbol_id string, parent_id string, project_id string, project_name string, kind string, method_kind string, is_implicit boolean, display_name string, documentation_id string, metadata_name string"
PLACES = "symbol_id string, path string, first_line int, first_char int, last_line int, last_char int"


def facts(spark, body="Bake"):
    def symbol(key, parent, project, kind, name, doc, method=None, implicit=False):
        return (key, parent, f"p:{project}", project, kind, method, implicit, name, doc, doc[2:])

    symbols = [
        symbol("n1", None, "Dough", "Namespace", "Dough", "N:Dough"),
        symbol("n0", None, "Oven", "Namespace", "Outer", "N:Outer"),  # declared nowhere by itself
        symbol("n2", "n0", "Oven", "Namespace", "Oven", "N:Outer.Oven"),
        symbol("t1", "n1", "Dough", "Type", "IBread", "T:Dough.IBread"),
        symbol("m1", "t1", "Dough", "Method", "Bake", "M:Dough.IBread.Bake", "Ordinary"),
        symbol("t2", "n2", "Oven", "Type", "Loaf", "T:Outer.Oven.Loaf"),
        symbol("m2", "t2", "Oven", "Method", body, f"M:Outer.Oven.Loaf.{body}", "Ordinary"),
        symbol("m3", "t2", "Oven", "Method", "get_X", "M:Outer.Oven.Loaf.get_X", "PropertyGet"),
        symbol("m4", "t2", "Oven", "Method", "ctor", "M:Outer.Oven.Loaf.ctor", "Constructor", True),
        symbol("t3", "n2", "Oven", "Type", "Made", "T:Outer.Oven.Made"),  # in a generated file only
        symbol("t4", "t3", "Oven", "Type", "Inner", "T:Outer.Oven.Made.Inner"),
        symbol("m5", "t4", "Oven", "Method", "Hidden", "M:Outer.Oven.Made.Inner.Hidden", "Ordinary"),
        symbol("t5", None, "Shop", "Type", "Counter", "T:Counter"),
        symbol("m6", "t5", "Shop", "Method", "Sell", "M:Counter.Sell", "Ordinary"),
        symbol("t6", None, "Other", "Type", "Lone", "T:Lone"),
    ]
    places = [("n1", "d/B.cs", 1, 0, 9, 0), ("n2", "o/L.cs", 1, 0, 30, 0), ("n2", "o/M.cs", 1, 0, 9, 0), ("t1", "d/B.cs", 2, 0, 8, 0), ("m1", "d/B.cs", 3, 4, 3, 20), ("t2", "o/L.cs", 3, 0, 20, 0), ("t2", "o/L.cs", 3, 0, 20, 0)]
    places += [("m2", "o/L.cs", 5, 4, 9, 5), ("m3", "o/L.cs", 11, 4, 11, 9), ("m4", "o/L.cs", 3, 0, 3, 5), ("t3", "o/M.g.cs", 2, 0, 9, 0), ("t4", "o/M.cs", 2, 0, 9, 0), ("m5", "o/M.cs", 3, 0, 4, 0), ("t5", "s/C.cs", 1, 0, 9, 0), ("m6", "s/C.cs", 2, 0, 6, 0), ("t6", "x/L.cs", 1, 0, 2, 0)]
    calls = [("o/L.cs", 6, 8, "m2"), ("o/L.cs", 7, 8, "m1"), ("o/L.cs", 7, 8, "m1"), ("o/L.cs", 15, 2, "m1"), ("o/L.cs", 6, 9, "m3"), ("s/C.cs", 3, 1, "m2"), ("o/M.cs", 3, 5, "m1")]
    return {
        "symbols": spark.createDataFrame(symbols, SYMBOLS),
        "places": spark.createDataFrame(places, PLACES),
        "relations": spark.createDataFrame([("implements", "t2", "t1"), ("implements", "m2", "m1"), ("inherits", "t4", "t2")], "kind string, symbol_id string, target_id string"),
        "occurrences": spark.createDataFrame(calls, "path string, line int, character int, target_id string"),
        "documents": spark.createDataFrame([("p:Dough", "d/B.cs"), ("p:Oven", "o/L.cs"), ("p:Oven", "o/M.g.cs"), ("p:Oven", "o/M.cs"), ("p:Shop", "s/C.cs"), ("p:Other", "x/L.cs")], "project_id string, path string"),
        "projects": spark.createDataFrame([("p:Dough", "Dough", "d/D.csproj", []), ("p:Oven", "Oven", "o/O.csproj", ["p:Dough", "p:gone"]), ("p:Shop", "Shop", "s/S.csproj", ["p:Oven"]), ("p:Other", "Other", "x/X.csproj", [])], "project_id string, project_name string, path string, references array<string>"),
    }


def states(spark, **changed):
    return spark.createDataFrame([(f"p:{n}", n, f"{n}.csproj", changed.get(n, "1"), []) for n in ("Dough", "Oven", "Shop", "Other")], schema.PROJECT_STATES)


def workspace(spark, **more):
    other = {"symbols": "source_symbols", "occurrences": "call_sites"}
    return Workspace(**{other.get(k, k): v for k, v in facts(spark).items()}, **more)


def names(df):
    return {r.id.split("::")[-1] for r in df.collect() if "::" in r.id}


def links(edges, kind):
    return {(r.source_id.split("::")[-1], r.target_id.split("::")[-1]) for r in edges.where(F.col("kind") == kind).collect()}


def test_whole_build(spark):
    got = build.build_graph(facts(spark), states(spark))
    assert names(got["nodes"]) == {"N:Dough", "N:Outer.Oven", "T:Dough.IBread", "M:Dough.IBread.Bake", "T:Outer.Oven.Loaf", "M:Outer.Oven.Loaf.Bake", "T:Counter", "M:Counter.Sell", "T:Lone"}
    edges = got["edges"]
    loaf, bake = "T:Outer.Oven.Loaf", "M:Outer.Oven.Loaf.Bake"
    assert {("p:Oven", "N:Outer.Oven"), ("N:Outer.Oven", loaf), (loaf, bake), ("p:Shop", "T:Counter"), ("p:Oven", "document:o/L.cs"), ("solution", "p:Shop")} <= links(edges, "contains")
    assert links(edges, "calls") == {(bake, "M:Dough.IBread.Bake"), (loaf, "M:Dough.IBread.Bake"), ("M:Counter.Sell", bake)}  # no self call, none to or from what is no node
    assert links(edges, "implements") == {(loaf, "T:Dough.IBread"), (bake, "M:Dough.IBread.Bake")} and links(edges, "inherits") == set()
    assert ("N:Outer.Oven", "document:o/M.cs") in links(edges, "declared_in") and links(edges, "depends_on_project") == {("p:Oven", "p:Dough"), ("p:Shop", "p:Oven")}
    assert edges.count() == edges.distinct().count() and got["nodes"].columns == [c.split()[0] for c in schema.NODES.split(", ")]
    every = build.build_graph(facts(spark), states(spark), include_generated=True)
    assert {"T:Outer.Oven.Made", "T:Outer.Oven.Made.Inner", "M:Outer.Oven.Made.Inner.Hidden"} <= names(every["nodes"])


def test_incremental_build_equals_a_whole_one(spark):
    before = build.build_graph(facts(spark), states(spark))
    old = {k: spark.createDataFrame(before[k].collect(), before[k].schema) for k in ("nodes", "edges", "project_states")}
    changed = facts(spark, body="BakeLong")
    got = build.build_graph(changed, states(spark, Oven="2"), old)
    assert {r.id for r in got["rebuilt"].collect()} == {"p:Oven", "p:Shop"}
    want = build.build_graph(changed, states(spark, Oven="2"))
    for k in ("nodes", "edges"):
        assert sorted(map(str, got[k].collect())) == sorted(map(str, want[k].collect()))
    assert build.build_graph(changed, states(spark, Oven="2"), {**old, "project_states": states(spark, Oven="2")})["rebuilt"].count() == 0


def shuffles(spark):
    """Numbers of the shuffles of which files are on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names_ = (files.apply(i).getName() for i in range(files.size()))
    return {n.split("_")[1] for n in names_ if n.startswith("shuffle_")}


def test_steps_of_a_build_leave_little_on_disk(spark):
    """What a step shuffles goes when it ends, and of the tables that steps write only those stay that the result is read from."""
    given, now = facts(spark), states(spark)
    before, stood = shuffles(spark), set(storage._WRITTEN.get(spark.sparkContext.applicationId, []))
    build.build_graph(given, now)
    for _ in range(50):  # files are deleted a little later
        left = shuffles(spark) - before
        if len(left) <= 2:
            break
        time.sleep(0.2)
    assert len(left) <= 2  # of the table of stale projects
    kept = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._WRITTEN[spark.sparkContext.applicationId] if p not in stood}
    assert kept == {"stale", "own-symbols", "held", "placed", "related", "called"}
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_incremental_query_keeps_of_the_first_build_the_snapshot_only(spark, monkeypatch):
    """Of the first build only its nodes and edges are left when the second begins."""
    stood, left = set(storage._WRITTEN.get(spark.sparkContext.applicationId, [])), []
    plain = build.build_graph

    def seen(given, now, old=None):
        left.append({p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._WRITTEN.get(spark.sparkContext.applicationId, []) if p not in stood})
        return plain(given, now, old)

    monkeypatch.setattr(build, "build_graph", seen)
    source.build_graph_incremental(spark, SMALLEST)
    assert left == [set(), {"old-nodes", "old-edges"}]


def test_snapshot_or_build(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    ws = workspace(spark, states=states(spark))
    assert ws.build_code_graph(path, "all.sln") == {"reason": "no snapshot of this schema", "rebuilt": ["p:Dough", "p:Other", "p:Oven", "p:Shop"], "reused": []}
    assert ws.nodes.count() > 10 and build.has_calls(ws.edges)
    ws = workspace(spark, states=states(spark, Shop="2"))
    assert ws.build_code_graph(path, "all.sln") == {"reason": None, "rebuilt": ["p:Shop"], "reused": ["p:Dough", "p:Other", "p:Oven"]}
    assert ws.build_code_graph(path, "other.sln")["reason"] == "another workspace"
    assert ws.build_code_graph(path, "other.sln", include_generated=True)["reason"] == "other options"
    fresh = workspace(spark, states=states(spark))
    assert fresh.load_graph(path, "other.sln") and fresh.nodes.count() > 10


SOURCE = {
    "d/B.cs": "namespace Dough;\ninterface IBread {\n  void Bake();\n}",
    "o/L.cs": "namespace Outer.Oven;\n//\nclass Loaf : IBread {\n//\n  public void Bake() {\n  }\n}\nclass Warmer : BackgroundService { }",
    "s/Program.cs": "var app = builder.Build();\napp.MapGet(\"/bread\", () => 1);\nservices.AddScoped<IBread, Loaf>();\nservices.AddHostedService<Warmer>();\nservices.AddScoped<ILone>();",
    "s/C.cs": "public class Counter(IBread bread) {\n  public void Sell() { }\n}",
    "x/L.cs": "public class Lone(IEnumerable<IBread> all) { }",
    "s/Shop.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web" />', "d/D.csproj": "<Project />", "o/O.csproj": "<broken", "x/X.csproj": "<Project />",
}


def with_files(spark, body="Bake", **changed):
    given = facts(spark, body)
    given["documents"] = given["documents"].unionByName(spark.createDataFrame([("p:Shop", "s/Program.cs")], given["documents"].schema))
    return given | {"files": spark.createDataFrame([*{**SOURCE, **changed}.items(), ("stray/Z.cs", "services.AddScoped<IBread, Loaf>();")], schema.FILES)}


def test_registrations_and_entrypoints_of_a_build(spark):
    got = build.build_graph(with_files(spark), states(spark))
    nodes, edges = (storage.materialize(got[name], name) for name in ("nodes", "edges"))
    made = {(r.kind, r.display_name, r.project_name, r.file_path) for r in nodes.where("kind in ('Entrypoint', 'DiRegistration')").collect()}
    assert made == {
        ("Entrypoint", "Shop", "Shop", "s/Program.cs"), ("Entrypoint", 'app.MapGet("/bread", () => 1);', "Shop", "s/Program.cs"), ("Entrypoint", "services.AddHostedService<Warmer>();", "Shop", "s/Program.cs"),
        ("Entrypoint", "class Warmer : BackgroundService { }", "Oven", "o/L.cs"), ("DiRegistration", "Scoped IBread -> Loaf", "Shop", "s/Program.cs"), ("DiRegistration", "Scoped ILone -> ILone", "Shop", "s/Program.cs"),
    }
    bread = nodes.where("display_name = 'Scoped IBread -> Loaf'").first().id
    assert {t for s, t in links(edges, "registered_as") if s == bread} == {"T:Dough.IBread", "T:Outer.Oven.Loaf"}
    assert {t for s, t in links(edges, "consumed_by") if s == bread} == {"T:Counter", "T:Lone"}
    assert (bread, "document:s/Program.cs") in links(edges, "declared_in") and ("p:Shop", bread) in links(edges, "contains")
    ws = Workspace(nodes=nodes, edges=edges)
    found = {r.section for r in ws.impact_sections("T:Outer.Oven.Loaf").collect()}
    assert {"target", "registration", "entrypoint", "caller"} <= found


def test_incremental_builds_with_text_equal_whole_ones(spark, tmp_path, monkeypatch):
    """Random changes of the text of some projects, one after another, each built upon the last; only changed projects are scanned."""
    rng, old, text, mark = random.Random(7), None, dict(SOURCE), dict.fromkeys(("Dough", "Oven", "Shop", "Other"), 0)
    of = {"d": "Dough", "o": "Oven", "s": "Shop", "x": "Other"}
    lines = ["services.AddScoped<IBread, Loaf>();", "services.AddSingleton<Lone>();", "class Baker(IBread b) { }", 'app.MapPost("/x", y);', "class Timer : BackgroundService { }", "services.AddScoped<IBread>(p => new Loaf());", ""]
    scanned = []
    plain_scan = build.derived.scan
    monkeypatch.setattr(build.derived, "scan", lambda f, d, p: scanned.append({r.project_id for r in p.collect()}) or plain_scan(f, d, p))
    path = f"file://{tmp_path}/g"
    for step in range(3):
        before = dict(mark)
        for file in rng.sample(sorted(p for p in text if p.endswith(".cs")), 2 if step else 0):
            text[file] = "\n".join(rng.choices(lines, k=4))
            mark[of[file[0]]] += 1
        now = states(spark, **{k: str(v) for k, v in mark.items()})
        want = build.build_graph(with_files(spark, **text), now)
        assert len(scanned.pop()) == 4
        if step:
            got = build.build_graph(with_files(spark, **text), now, old)
            assert scanned.pop() == {f"p:{k}" for k in mark if mark[k] != before[k]}
            for k in ("nodes", "edges", "registrations", "entrypoints"):
                assert sorted(map(str, got[k].collect())) == sorted(map(str, want[k].collect())), (step, k)
        snapshot.write_snapshot(want, path, "t", "o")
        old = snapshot.read_snapshot(spark, path)
    assert old["registrations"].count() and old["nodes"].where("kind = 'DiRegistration'").count()


def test_projects_of_one_name_are_refused(spark):
    given = with_files(spark)
    given["projects"] = given["projects"].unionByName(spark.createDataFrame([("p:2", "SHOP", "z/S.csproj", [])], given["projects"].schema))
    with pytest.raises(ValueError, match="several projects are named"):
        build.build_graph(given, states(spark))
