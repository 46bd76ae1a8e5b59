"""The steps of a change, their commands with all fallbacks, and the diagnostics in focus."""

import pytest

from graphloom import schema
from graphloom.plans import steps
from graphloom.plans.workspace import Workspace

FOUND = "section string, place int, id string, path string, line int, total long"
PROJECTS = "project_id string, project_name string, path string, is_test boolean"


def sections(spark):
    rows = [
        ("target", 1, "t1", "src/A/Mill.cs", 1), ("target", 2, "t2", "tests/A/MillTests.cs", 1), ("caller", 1, "c1", "src/B/Use.cs", 4), ("caller", 2, "c2", "SRC/A/mill.cs", 9),
        ("relation", 1, "r1", "src/B/use.cs", 2), ("relation", 2, "r2", "src/A/Sub.cs", 2), ("registration", 1, "g1", "src/B/Use.cs", 8), ("registration", 2, "g2", "src/B/Di.cs", 1),
        ("entrypoint", 1, "e1", "src/B/Program.cs", 1), ("entrypoint", 2, "e2", None, None), ("test", 1, "x1", "tests/A/MillTests.cs", None),
    ]
    return spark.createDataFrame([(*r, 2) for r in rows], FOUND)


def node_table(spark):
    rows = [(i, "Type", i, p) for i, p in (("t1", "A"), ("c1", "B"))] + [("e2", "Entrypoint", "Host", None)]
    return spark.createDataFrame(rows, "id string, kind string, display_name string, project_name string")


def project_table(spark):
    rows = [("A", "src/A/A.csproj", False), ("B", "src/B/B.csproj", False), ("A.Tests", "tests/A/A.Tests.csproj", True), ("Host", "host/Host.csproj", False), ("Other", "o/Other.csproj", False)]
    return spark.createDataFrame([("p:" + n, n, p, t) for n, p, t in rows], PROJECTS)


def test_steps_of_a_plan(spark):
    solutions = spark.createDataFrame([("All.sln",), ("b.sln",)], "path string")
    got = [(r.phase, r.step, r.title, r.command, list(r.targets), r.truncated) for r in steps.plan(sections(spark), node_table(spark), project_table(spark), solutions, 10).collect()]
    assert got[:8] == [
        ("inspect", 1, "Inspect primary change targets", "", ["src/A/Mill.cs"], 0),
        ("inspect", 2, "Inspect direct callers", "", ["src/B/Use.cs", "SRC/A/mill.cs"], 0),
        ("inspect", 3, "Inspect inheritance and override surfaces", "", ["src/B/use.cs", "src/A/Sub.cs"], 0),
        ("inspect", 4, "Inspect runtime wiring", "", ["src/B/Use.cs", "src/B/Di.cs", "src/B/Program.cs"], 0),
        ("inspect", 5, "Inspect related tests", "", ["A.Tests"], 0),
        ("edit", 1, "Edit primary implementation files", "", ["src/A/Mill.cs"], 0),
        ("edit", 2, "Adjust dependent code paths", "", ["src/B/Use.cs", "src/A/Sub.cs"], 0),
        ("edit", 3, "Reconcile runtime wiring if needed", "", ["src/B/Di.cs", "src/B/Program.cs"], 0),
    ]
    assert [(r[0], r[1], r[3]) for r in got[8:]] == [("verify", 1, "dotnet build All.sln"), ("verify", 2, "dotnet test tests/A/A.Tests.csproj"), ("verify", 3, "")]
    assert got[8][4] == ["A", "B", "Host"] and [t.lower() for t in got[10][4][:2]] == ["src/b/use.cs", "src/a/mill.cs"]  # 210 and 180 points
    cut = {r.title: (list(r.targets), r.truncated) for r in steps.inspect_and_edit(sections(spark), project_table(spark), 1).collect()}
    assert cut["Inspect runtime wiring"] == (["src/B/Use.cs"], 2) and cut["Adjust dependent code paths"] == (["src/B/Use.cs"], 1)


def test_fallbacks_of_commands(spark):
    found, nodes, projects = sections(spark), node_table(spark), project_table(spark)
    none, one = spark.createDataFrame([], "path string"), spark.createDataFrame([("All.sln",)], "path string")
    changed = spark.createDataFrame([("src/B/New.cs",), (" ",)], "path string")

    def told(found, changed, projects, solutions):
        return [r.command for r in steps.verification(found, changed, nodes, projects, solutions).collect()]

    assert told(None, changed, projects, none) == ["dotnet build src/B/B.csproj", ""]  # no solution, no test project changed
    assert told(None, changed, projects, one) == ["dotnet build All.sln", "dotnet test All.sln", ""]
    assert told(None, changed, projects.where("not is_test"), one) == ["dotnet build All.sln", ""]
    assert told(None, spark.createDataFrame([("tests/A/T.cs",)], "path string"), projects, one) == ["dotnet build All.sln", "dotnet test tests/A/A.Tests.csproj", ""]
    assert told(found, none, projects, none) == ["dotnet build src/A/A.csproj", "dotnet test tests/A/A.Tests.csproj", ""]
    assert told(found.where("section = 'target'"), none, projects, one) == ["dotnet build All.sln", "dotnet test All.sln", ""]
    assert told(found.limit(0), none, projects, none) == ["dotnet build src/A/A.csproj"]  # nothing is impacted: the first project
    assert told(None, none, projects.limit(0), none) == []
    assert steps.plan(found.limit(0), nodes, projects.limit(0), none).count() == 0


def test_diagnostics_in_focus(spark):
    rows = spark.createDataFrame([("src/A/Mill.cs", 1, "x"), ("src\\B\\New.cs", 2, "y"), ("z.cs", 1, "z"), ("src/A/Mill.cs", 4, "hint")], "uri string, severity int, message string")
    none, changed = spark.createDataFrame([], "path string"), spark.createDataFrame([("SRC/B/new.cs",)], "path string")

    def told(found, changed):
        return sorted(r.message for r in steps.focused_diagnostics(found, changed, rows).collect())

    assert told(sections(spark), changed) == ["x", "y"] and told(None, changed) == ["y"] and told(None, none) == ["x", "y", "z"]
    ws = Workspace(diagnostics=rows)
    assert sorted(r.message for r in ws.verify_change(changed).collect()) == ["y"]
    with pytest.raises(ValueError):
        ws.verify_change()


def test_workspace_plans_and_checks(spark):
    nodes = spark.createDataFrame([("s1", "Type", "Mill", "A", "p:A", "src/A/Mill.cs", 1, 0, "T:Mill", "Mill"), ("s2", "Type", "MillTests", "T", "p:T", "tests/T/MillTests.cs", 1, 0, "T:MillTests", "MillTests")], schema.NODES)
    edges = spark.createDataFrame([], schema.EDGES)
    files = spark.createDataFrame([("W.sln", ""), ("src/A/A.csproj", "<Project />"), ("tests/T/T.csproj", "<Project />"), ("src/A/Mill.cs", "class Mill { }"), ("tests/T/MillTests.cs", "Mill m;")], schema.FILES)
    ws = Workspace(nodes=nodes, edges=edges, files=files)
    got = [(r.phase, r.command, list(r.targets)) for r in ws.plan_change("Mill").collect()]
    assert got[0] == ("inspect", "", ["src/A/Mill.cs"]) and ("verify", "dotnet test tests/T/T.csproj", ["tests/T/T.csproj"]) in got and ("verify", "dotnet build W.sln", ["A"]) in got
    assert [r.command for r in ws.verification_steps(spark.createDataFrame([("src/A/Mill.cs",)], "path string")).collect()] == ["dotnet build W.sln", "dotnet test W.sln", ""]
