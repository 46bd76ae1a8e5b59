"""Registrations and entrypoints on a graph, and results at the edge."""

import json

from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import facts, overlay
from graphloom.sources import output


def test_entrypoints_and_projects(spark):
    projects = spark.createDataFrame([("p1", "App", "src/App/App.csproj", "web"), ("p2", "Sub", "src/App/Sub/Sub.csproj", "classlib")], "project_id string, project_name string, path string, type string")
    found = spark.createDataFrame([("aspnet_route", "src/App/E.cs", 3, 'app.MapGet("/a|b", x);'), ("aspnet_route", "src/App/Sub/F.cs", 1, "y"), ("aspnet_route", "other/G.cs", 1, "z")], "category string, path string, line int, text string")
    nodes, edges = overlay.entrypoints(overlay.with_project(found, projects))
    assert {(r.file_path, r.owning_project_id) for r in nodes.collect()} == {("src/App/E.cs", "p1"), ("src/App/Sub/F.cs", "p2")}
    assert nodes.columns == [c.split()[0] for c in schema.NODES.split(", ")]
    assert {r.kind for r in edges.collect()} == {"contains", "declared_in"} and edges.count() == 4
    assert {r.project_id for r in overlay.project_by_segment(found, projects).where("path like '%F.cs'").collect()} == {"p1"}  # names of one length: the first id
    assert [r.display_name for r in overlay.host_entrypoints(projects)[0].collect()] == ["App"]


def test_registrations_on_the_graph(spark):
    files = spark.createDataFrame([("src/App/Di.cs", "services.AddScoped<IFoo, Foo>();"), ("src/App/Use.cs", "namespace A;\npublic class User(IEnumerable<IFoo> foos) { }")], schema.FILES)
    named = {"project_id": F.lit("p1"), "project_name": F.lit("App")}
    types = spark.createDataFrame([("t1", "IFoo", "A.IFoo", "App"), ("t2", "Foo", "A.Foo", "App"), ("t3", "Other", "A.Other", "App")], "id string, display_name string, metadata_name string, project string")
    kind = "id string, kind string, project_name string, file_path string, line int"
    members = spark.createDataFrame([("u", "Method", "App", "src/App/Use.cs", 2), ("t", "Type", "App", "src/App/Use.cs", 2), ("n", "Namespace", "App", "src/App/Use.cs", 2), ("early", "Type", "App", "src/App/Use.cs", 1), ("late", "Type", "App", "src/App/Use.cs", 9)], kind)
    nodes, edges = overlay.registrations(facts.registrations(files).withColumns(named), facts.consumers(files).withColumns(named), types, members)
    node = nodes.first()
    assert node.display_name == "Scoped IFoo -> Foo" and node.documentation_id == "di|Scoped|IFoo|Foo|direct|single"
    assert {(r.kind, r.target_id) for r in edges.where("kind in ('registered_as', 'consumed_by')").collect()} == {("registered_as", "t1"), ("registered_as", "t2"), ("consumed_by", "u")}


def test_enclosing_members(spark):
    kind = "id string, kind string, project_name string, file_path string, line int"
    members = spark.createDataFrame([("a", "Type", "A", "x.cs", 1), ("b", "Method", "B", "x.cs", 5), ("c", "Field", "A", "x.cs", 3), ("d", "Property", "A", "x.cs", 3), ("e", "Method", "A", "x.cs", None)], kind)
    sites = spark.createDataFrame([(1, "x.cs", 6, "a"), (2, "x.cs", 6, "Z"), (3, "x.cs", 2, "A"), (4, "x.cs", 0, "A"), (5, "y.cs", 9, "A"), (6, "x.cs", 4, "B")], "use_id int, path string, line int, project_name string")
    assert {r.use_id: r.id for r in overlay.enclosing_members(sites, members).collect()} == {1: "d", 2: "b", 3: "a", 6: "d"}  # the site's project goes before the nearer line


def test_entrypoint_files_and_probes(spark):
    files = spark.createDataFrame([("a/Program.cs", "", "p"), ("a/bin/Program.cs", "", "p"), *[(f"a/W{i}Worker.cs", "", "p") for i in range(5)], ("a/L.cs", "Handler(ILambdaContext c)", "p")], "path string, content string, project_id string")
    got = overlay.entrypoint_files(files)
    assert {(r.kind, r.n) for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("program", 1), ("worker", 3), ("serverless", 1)}
    rows = facts.lines(spark.createDataFrame([("a.cs", "int Run(int x)\n{\n  if (x) Go(1); // Never()\n  var y = new Thing(2);\n  return Run(x) + this.Stop();\n}")], schema.FILES))
    assert [r.name for r in overlay.invocation_probes(rows, "Run").collect()] == ["Go", "Stop"]


def test_envelope_and_names(spark):
    good = json.loads(output.run_tool("t", lambda: spark.createDataFrame([(1, None)], "a int, b string")))
    assert good["success"] and good["data"] == [{"a": 1}]
    assert json.loads(output.run_tool("t", lambda: facts.semantic_search(None, "x")))["success"] is False
    assert output.export_path("/o", "focus", "A.b C", "dot", name="x") == "/o/x.dot" and output.export_path("/o", "focus", "A.b C", "mermaid").endswith("-focus-a-b-c.mmd")
    assert output.workspace_target(["b.csproj", "z.sln", "a.sln"]) == "a.sln" and output.workspace_target([]) is None
