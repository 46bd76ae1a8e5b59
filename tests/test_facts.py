"""Facts, joins and searches over small source files."""

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import diagnostics, facts
from graphloom.plans.workspace import Workspace

REGISTRATIONS = """// the wiring of a tea room
builder.Services.TryAddTransient<IKettle, CopperKettle>();
builder.Services.AddSingleton<SunDial>();
builder.Services.AddScoped<ITimePiece>(
    provider =>
    provider.GetRequiredService<SunDial>());
builder.Services.TryAddEnumerable(
    ServiceDescriptor.Transient<IDrain, StoneDrain>());
builder.Services.AddSingleton<IShelf>(_ => new OakShelf(3));
"""
CONSUMERS = """
internal sealed class TeaRoom(IReadOnlyList<IDrain> drains, [Cold] IKettle kettle = null) { }
public class Tower { public Tower(ILogger<IKettle> log, ITimePiece piece) { } }
"""


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".cs", v) for k, v in texts.items()], schema.FILES)


def test_registrations(spark):
    got = {(r.service, r.implementation, r.lifetime, r.is_factory, r.is_enumerable, r.line) for r in facts.registrations(files(spark, src__Di=REGISTRATIONS)).collect()}
    assert got == {
        ("IKettle", "CopperKettle", "Transient", False, False, 2),
        ("SunDial", "SunDial", "Singleton", False, False, 3),
        ("ITimePiece", "SunDial", "Scoped", True, False, 4),
        ("IDrain", "StoneDrain", "Transient", False, True, 7),
        ("IShelf", "OakShelf", "Singleton", True, False, 9),
    }


def test_consumers_and_their_registrations(spark):
    used = facts.consumers(files(spark, src__C=CONSUMERS)).withColumns({"use_id": F.col("display"), "project": F.lit("A")})
    registered = spark.createDataFrame([(1, "IKettle", "A"), (2, "IDrain", "A"), (3, "ITimePiece", "A"), (4, "X", "A"), (5, "IKettle", "B")], "reg_id int, type string, project string")
    got = {(r.reg_id, r.use_id.split("(")[0]) for r in facts.registration_consumers(registered, used).collect()}
    assert got == {(1, "TeaRoom"), (2, "TeaRoom"), (3, "Tower")}  # a logger of a type doesn't use it, and a name of two projects stays in its own


def test_unresolved_type_names_match_nothing(spark):
    registered = spark.createDataFrame([(1, "Nowhere", "A"), (2, "Foo", "A")], "reg_id int, type string, project string")
    types = spark.createDataFrame([("t1", "Foo", "A.Foo", "B"), ("t2", "Foo", "B.Foo", "A"), ("t3", "Bar", "A.Bar", "A")], "id string, display_name string, metadata_name string, project string")
    assert {(r.reg_id, r.id) for r in facts.best_types(registered, types).collect()} == {(2, "t2")}


SEARCHED = {
    "src__Routes__Tea": 'routes.MapPut("/cups", pour);\nvar group = app.MapGroup("/leaves");\n// nothing\napp.UseRateLimiter();',
    "src__Jobs__Digger": "internal class Digger : BackgroundService { }",
    "src__Program": 'services.AddHostedService<Digger>();\nservices.AddOptions<HarbourOptions>()\n    .Validate(x => x.Deep)\n    .Bind(configuration.GetSection("Harbour"));\nservices.Configure<CraneOptions>(config.GetSection("Crane"));\nservices.AddTransient<IKettle, CopperKettle>();',
    "tests__TeaTests": 'app.MapGet("/only-here", x);',
    "src__obj__Made": 'app.MapGet("/made", x);',
}


@pytest.mark.parametrize(
    ("mode", "kinds"),
    [
        ("aspnet_endpoints", ["MapGroup", "MapPut"]),
        ("hosted_services", ["implementation:Digger", "registration:Digger"]),
        ("config_bindings", ["bind:HarbourOptions", "configure:CraneOptions"]),
        ("middleware_pipeline", ["UseRateLimiter"]),
        ("di_registrations", ["Transient:IKettle"]),
    ],
)
def test_semantic_search(spark, mode, kinds):
    assert sorted(r.kind for r in facts.semantic_search(files(spark, **SEARCHED), mode).collect()) == kinds


def test_unknown_mode_names_the_modes(spark):
    with pytest.raises(ValueError, match="aspnet_endpoints"):
        facts.semantic_search(files(spark, a=""), "nothing")


DEAD = """
class Mill {
    private readonly Sieve _sieve = new Sieve();
    private const int Forgotten = 7;
    private bool Grind(int grains) { return _sieve.Shake(grains.Doubled()); }
    private static void SweepFloor() { }
    public void Run() { Grind(1); }
}
internal sealed class Sieve { public bool Shake(int n) => n > 0; }
internal record LostPart(int Size);
internal static class Numbers { internal static int Doubled(this int n) { return 2 * n; } }
internal static class NobodyCalls { public static int Halved(int n) { return n / 2; } }
"""


def test_dead_code(spark):
    got = {(r.kind, r.name, r.line) for r in Workspace(files=files(spark, src__C=DEAD, tests__T="LostPart x;")).dead_code().collect()}
    assert got == {("private-field", "Forgotten", 4), ("private-method", "SweepFloor", 6), ("internal-type", "LostPart", 10), ("internal-type", "NobodyCalls", 12)}


def test_test_map(spark):
    own = files(spark, tests__ParcelSorterTests="var s = new ParcelSorter();\n// parcelsorter", tests__Depot="a\nParcelSorter x;\nParcelSorter y;\nParcelSorter z;\nParcelSorter w;", src__A="class ParcelSorter { }\nstruct Chute { }", tests__Chute="")
    ws = Workspace(files=own)
    got = [(r.path, r.score, r.reasons, r.lines, r.more_lines) for r in ws.test_map(["ParcelSorter"]).collect()]
    assert got == [
        ("tests/ParcelSorterTests.cs", 120, "file:ParcelSorter,content:2", ["1: var s = new ParcelSorter();", "2: // parcelsorter"], 0),
        ("tests/Depot.cs", 40, "content:4", ["2: ParcelSorter x;", "3: ParcelSorter y;", "4: ParcelSorter z;"], 1),
    ]
    assert [r.path for r in ws.test_map(query="Post.ParcelSorter", k=1).collect()] == ["tests/ParcelSorterTests.cs"]
    assert "tests/Chute.cs" in {r.path for r in ws.test_map(path="src/A.cs").collect()}
    with pytest.raises(ValueError):
        ws.test_map()


def test_registration_report(spark):
    project = "<Project />"
    own = {"a__A.csproj": project, "b__B.csproj": project, "a__Di.cs": REGISTRATIONS, "b__Di.cs": "services.AddScoped<IKettle, TinKettle>();", "a__Use.cs": CONSUMERS + "class Guest(IKettle k) { }", "c__Use.cs": "class Far(IKettle k) { }"}
    ws = Workspace(files=spark.createDataFrame([(k.replace("__", "/"), v) for k, v in own.items()], schema.FILES))
    got = [(r.project, r.implementation, len(r.consumers), r.truncated_consumers, r.total) for r in ws.find_registrations("kettle", consumers=True).collect()]
    assert got == [("A", "CopperKettle", 2, 0, 2), ("B", "TinKettle", 0, 0, 2)]  # the name is ambiguous, so users of other projects match neither
    first = ws.find_registrations(consumers=True, k=1).collect()
    assert [(r.service, r.total, r.truncated_consumers) for r in first] == [("IDrain", 6, 0)]
    assert ws.find_registrations("nothing").count() == 0 and [r.consumers for r in ws.find_registrations("IShelf").collect()] == [[]]


def test_entrypoints_overview_and_startup(spark):
    web = '<Project Sdk="Microsoft.NET.Sdk.Web" />'
    lib = '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><ProjectReference Include="../Web/Web.csproj" /></ItemGroup></Project>'
    own = {"Web/Web.csproj": web, "Lib/Lib.csproj": lib, "Web/Program.cs": 'app.UseRouting();\napp.MapGet("/a", x);\napp.MapHealthChecks("/h");', "Lib/PumpWorker.cs": "class Pump : BackgroundService { }"}
    ws = Workspace(files=spark.createDataFrame(list(own.items()), schema.FILES))
    got = {(r.category, r.kind, r.path) for r in ws.find_entrypoints().collect()}
    assert {("host_project", "web", "Web/Web.csproj"), ("aspnet_route", "MapGet", "Web/Program.cs"), ("hosted_service", "implementation:Pump", "Lib/PumpWorker.cs"), ("middleware", "UseRouting", "Web/Program.cs"), ("startup_call", "UseRouting", "Web/Program.cs")} <= got
    assert {r.path for r in ws.find_entrypoints("lib/").collect()} == {"Lib/PumpWorker.cs"}
    assert [r.text for r in ws.endpoint_composition().collect()] == ['app.MapHealthChecks("/h")']
    rows = {r.name: (r.type, r.referenced_by, [(e.kind, e.file) for e in r.entrypoint_files or []]) for r in ws.project_overview().collect()}
    assert rows == {"Web": ("web", ["Lib"], [("program", "Web/Program.cs")]), "Lib": ("classlib", None, [("worker", "Lib/PumpWorker.cs")])}
    assert {(r.type, r.framework, r.projects) for r in ws.project_totals().collect()} == {("web", None, 1), ("classlib", None, 1)}


def test_severity_and_exclusions(spark):
    rows = spark.createDataFrame([("f", 1, "A1", "x"), ("f", 2, "Skip", "x"), ("f", 3, None, "x"), ("f", 2, "Keep", "noise")], "uri string, severity int, code string, source string")
    assert [r.severity for r in diagnostics.filtered(rows, "nonsense").orderBy("severity", "code").collect()] == [1, 2, 2]
    kept = diagnostics.filtered(rows, "ALL", exclude_codes=["skip"], exclude_sources=["NOISE"]).collect()
    assert {r.code for r in kept} == {"A1", None}


def test_project_overview(spark):
    web = '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><ProjectReference Include="..\\Core\\Core.csproj" /></ItemGroup></Project>'
    worker = '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="Microsoft.Extensions.Hosting" /></ItemGroup></Project>'
    test = '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><PackageReference Include="xunit" /></ItemGroup></Project>'
    own = spark.createDataFrame([("src/App/App.csproj", web), ("src/Job/Job.csproj", worker), ("src/Check/Check.csproj", test)], schema.FILES)
    got = {r.name: (r.type, list(r.references), list(r.frameworks)) for r in Workspace(files=own).project_overview().collect()}
    assert got == {"App": ("web", ["Core"], ["net8.0"]), "Job": ("worker", [], []), "Check": ("test", [], [])}
