"""Symbols, exports, and what a change reaches."""

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import diagnostics
from graphloom.plans import change, export, symbols
from graphloom.plans.workspace import Workspace

SYMBOLS = "id string, name string, container_name string, path string, start_line int, start_char int, end_line int, end_char int"


def symbol_table(spark):
    rows = [("s1", "Mill", "Farm.Grain", "src/Mill.cs", 1, 0, 20, 1), ("s2", "Grind", "Farm.Grain.Mill", "src/Mill.cs", 3, 4, 6, 5), ("s3", "MillTests", "Farm.Grain", "tests/MillTests.cs", 1, 0, 9, 1), ("s4", "mill", None, "src/Other.cs", 1, 0, 2, 0), ("s5", "Windmill", "Sea", "src/W.cs", 1, 0, 2, 0)]
    return spark.createDataFrame(rows, SYMBOLS)


def test_search_falls_back_and_filters(spark):
    ws = Workspace(symbols=symbol_table(spark))
    assert [r.id for r in ws.search_symbols("Farm.Grain.Mill").collect()] == ["s1"]  # strong matches only
    assert {(r.id, r.fallback) for r in ws.search_symbols("Nowhere.Mill").collect()} == {(i, True) for i in ("s1", "s3", "s4", "s5")}
    assert [r.id for r in ws.search_symbols("Mill", 2).collect()] == ["s4", "s1"] and ws.search_symbols("nothing").count() == 0


def plain_score(q, name, container):
    simple = q.rsplit(".", 1)[-1]
    n, f = 0, str.upper
    n += 500 if name == q else 450 if f(name) == f(q) else 400 if name.startswith(q) else 350 if f(name).startswith(f(q)) else 250 if f(q) in f(name) else 0
    if simple != q:
        n += 475 if name == simple else 425 if f(name) == f(simple) else 225 if f(simple) in f(name) else 0
    whole = f"{container}.{name}" if container else name
    n += 600 if whole == q else 550 if f(whole) == f(q) else 300 if f(whole).endswith(f(q)) else 0
    if "." in q and container:
        head = q.rsplit(".", 1)[0]
        n += 350 if container == head else 325 if f(container) == f(head) else 200 if f(container).endswith(f(head)) else 0
    return n


def test_analysis_score(spark):
    for q in ("Mill", "mill", "MILLT", "Farm.Grain.Mill", "farm.grain.mill", "Grain.Mill", "x.Windmill", "Sea.windMILL"):
        got = symbol_table(spark).select("name", "container_name", symbols.analysis_score(q, F.col("name"), F.col("container_name")).alias("s")).collect()
        assert all(r.s == plain_score(q, r.name, r.container_name) for r in got)


def node(id_, kind, name, project=None, path=None, line=None, doc=None, meta=None):
    return (id_, kind, name, project, f"p:{project}" if project else None, path, line, 1, doc, meta)


def graph_tables(spark):
    nodes = [
        node("sln", "Solution", "all"), node("p:A", "Project", "A", "A", "a/A.csproj", meta="Asm.A"), node("p:AB", "Project", "AB", "AB", "b/AB.csproj"),
        node("ns", "Namespace", "Farm", "A"), node("s1", "Type", "Mill", "A", "src/Mill.cs", 1, "T:Farm.Mill", "Farm.Mill"), node("s2", "Method", "Grind", "A", "src/Mill.cs", 3, "M:Farm.Mill.Grind", "Grind"),
        node("i1", "Type", "IMill", "A", "src/IMill.cs", 1, "T:Farm.IMill", "Farm.IMill"), node("c1", "Method", "Call", "AB", "src/Call.cs", 5, "M:Other.Call", "Call"), node("d1", "Document", "Mill.cs", "A", "src/Mill.cs"),
        node("e1", "Entrypoint", "A", "A", "a/A.csproj", 1, "entrypoint|host_project|A|web host"), node("e2", "Entrypoint", "app.MapGet(mill)", "AB", "src/Routes.cs", 2, "entrypoint|aspnet_route||app.MapGet(mill)"), node("r1", "DiRegistration", "Scoped IMill", "A", "src/Di.cs", 4, "di|Scoped|IMill|Mill|direct|single"),
    ]
    edges = [("contains", "sln", "p:A"), ("contains", "p:A", "ns"), ("contains", "ns", "s1"), ("contains", "s1", "s2"), ("implements", "s1", "i1"), ("calls", "c1", "s2"), ("declared_in", "s1", "d1"), ("registered_as", "r1", "s1"), ("depends_on_project", "p:AB", "p:A")]
    return spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES)


def test_analyze_symbol(spark):
    nodes, edges = graph_tables(spark)
    definitions = spark.createDataFrame([("s1", "src/Mill.cs", 1)], "symbol_id string, path string, line int")
    occurrences = spark.createDataFrame([("s1", "src/A.cs", 3), ("s1", "tests/MillTests.cs", 4), ("s1", "tests/MillTests.cs", 8), ("s2", "src/A.cs", 9)], "symbol_id string, path string, line int")
    files = spark.createDataFrame([("src/Mill.cs", "class Mill {\n\n  void Grind() {\n    Shake(1);\n  }\n}")], schema.FILES)
    hovers = spark.createDataFrame([("src/Mill.cs", 1, 0, 20, 0, '{"kind":"markdown","value":"class Mill"}'), ("src/Mill.cs", 3, 4, 6, 5, '["void Grind()", {"value": "says"}]')], "path string, start_line int, start_char int, end_line int, end_char int, contents string")
    ws = Workspace(nodes=nodes, edges=edges, symbols=symbol_table(spark), definitions=definitions, occurrences=occurrences, files=files, hovers=hovers)
    got = {}
    for r in ws.analyze_symbol("Farm.Grain.Mill", k=1).collect():
        got[r.section] = (r.id, r.path, r.line, r.total, r.truncated)
    assert got == {"definition": ("s1", "src/Mill.cs", 1, 1, 0), "reference": ("s1", "src/A.cs", 3, 3, 2), "test": ("s1", "tests/MillTests.cs", 4, 2, 1), "supertype": ("i1", "src/IMill.cs", 1, 1, 0), "outgoing call": (None, "src/Mill.cs", 4, 1, 0)}
    inner = {(r.section, r.id, r.detail) for r in ws.analyze_symbol(path="src/Mill.cs", line=4, character=6).collect()}
    assert inner == {("reference", "s2", None), ("incoming call", "c1", "Call"), ("outgoing call", None, "Shake")}
    assert ws.analyze_symbol("Unheard").count() == 0
    with pytest.raises(ValueError):
        ws.analyze_symbol(" ")
    assert ws.hover("src/Mill.cs", 4, 0).first().text == "void Grind()\nsays" and ws.hover("src/Mill.cs", 12, 0).first().text == "class Mill" and ws.hover("x", 1, 1).count() == 0
    plain = spark.createDataFrame([('"a\\nb"',), ("bare text",)], "c string").select(symbols.hover_text(F.col("c")).alias("t")).collect()
    assert [r.t for r in plain] == ["a\nb", "bare text"]


def test_exports(spark):
    nodes, edges = graph_tables(spark)

    def scores(df):
        return {r.id: r.score for r in df[0].collect()}

    focus = scores(export.select(nodes, edges, "Mill"))
    assert focus["s1"] == 1000 and {focus[i] for i in ("ns", "s2", "i1", "r1")} == {800} and focus["e1"] == 400 and focus["p:A"] == 145 and "d1" not in focus and "c1" not in focus
    assert "d1" in scores(export.select(nodes, edges, "Mill", kinds=["declared_in"], documents=True))
    project = export.select(nodes, edges, "Unheard", "a")
    assert scores(project) == {"p:A": 1000, "p:AB": 850, "ns": 125, "s1": 80, "i1": 80, "e1": 90, "r1": 85, "sln": 150} and project[2] == ["No graph symbol matched 'Unheard'."]
    assert {r.id for r in export.matching_projects(nodes, "B.CSPROJ").collect()} == {"p:AB"} and {r.id for r in export.matching_projects(nodes, "asm.a").collect()} == {"p:A"}
    overview = export.select(nodes, edges, project="zzz", registrations=False)
    assert scores(overview) == {"sln": 1000, "p:A": 900, "p:AB": 900, "e1": 90, "e2": 90} and len(overview[2]) == 1
    assert {r.kind for r in overview[1].collect()} == {"contains", "depends_on_project"}
    with pytest.raises(ValueError, match="unknown edge kind 'Calls'"):
        export.edge_kinds(["calls ", "Calls", " "][1:])
    assert export.edge_kinds(["calls ", "", "calls"]) == ["calls"]
    ws = Workspace(nodes=nodes, edges=edges)
    assert ws.export_graph("Mill", "DOT").first().text.startswith("digraph") and "flowchart" in ws.export_graph(project="A").first().text
    with pytest.raises(ValueError):
        ws.export_graph("Mill", "svg")


def test_what_a_change_reaches(spark):
    nodes, edges = graph_tables(spark)
    files = spark.createDataFrame([("a/A.csproj", "<Project />"), ("a/Di.cs", "services.AddScoped<IMill, Mill>();\nservices.AddScoped<IDam, Dam>();"), ("a/U.cs", "class MillYard(IDam dam) { }"), ("t/tests/MillTests.cs", "Mill m;")], schema.FILES)
    projects = spark.createDataFrame([("p:A", "A", "a/A.csproj"), ("p:AB", "AB", "b/AB.csproj"), ("p:T", "T", "t/T.csproj"), ("p:Z", "Z", "z/Z.csproj")], "project_id string, project_name string, path string")
    ws = Workspace(nodes=nodes, edges=edges, files=files, projects=projects)
    found = {(r.section, r.id) for r in ws.impact_sections("Mill").collect()}
    assert {("target", "s1"), ("caller", "c1"), ("registration", "r1"), ("relation", "s1"), ("entrypoint", "e1"), ("entrypoint", "e2"), ("test", "test:t/tests/MillTests.cs")} == found
    assert [r.project_name for r in ws.impacted_projects("Mill").collect()] == ["A", "AB", "T"]
    assert {r.service for r in ws.impacted_registrations("Mill").collect()} == {"IMill", "IDam"}  # the second by its consumer MillYard
    assert {r.section for r in ws.impact_sections(path="src/Mill.cs").collect()} >= {"target", "caller"}
    tests = spark.createDataFrame([("target", 1, "t", "x/tests/A.cs", 1), ("target", 2, "u", "src/A.cs", 1), ("caller", 1, "v", "src/B.cs", 1)], "section string, place int, id string, path string, line int")
    assert [r.id for r in change.primary_targets(tests).collect()] == ["u"] and [r.id for r in change.primary_targets(tests.where("id = 't'")).collect()] == ["t"]


def test_diagnostic_totals_and_ranges(spark):
    rows = spark.createDataFrame([("a", 1, 2, 2, "x"), ("a", 2, 5, 6, "y"), ("b", 4, 1, 1, "z")], "uri string, severity int, start_line int, end_line int, message string").withColumn("start_char", F.lit(0))
    ws = Workspace(diagnostics=rows)
    assert tuple(ws.diagnostic_totals("WARNING").first()) == (2, 1) and tuple(diagnostics.totals(rows.limit(0)).first()) == (0, 0)
    assert [r.message for r in ws.document_diagnostics("a", 4, 6).collect()] == ["y"] and ws.document_diagnostics("a").count() == 2
