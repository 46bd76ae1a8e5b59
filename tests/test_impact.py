"""The entrypoint section of a change."""

from graphloom import schema
from graphloom.plans import impact


def test_entrypoints_by_name_path_and_host(spark):
    def node(id_, kind, display, project, path, documentation=None):
        return (id_, kind, display, project, project, path, 1, 1, documentation, None)

    rows = [
        node("type:1", "Type", "WeatherService", "Core", "src/Core/Weather.cs", "T:Core.WeatherService"),
        node("named", "Entrypoint", "app.MapGet(x)", "App", "src/App/A.cs", "entrypoint|aspnet_route|/w|app.MapGet(weatherservice.Get)"),
        node("same file", "Entrypoint", "app.MapPost(y)", "Other", "SRC/core/weather.cs", "entrypoint|aspnet_route||app.MapPost(y)"),
        node("host", "Entrypoint", "Core", "Core", "src/Core/Core.csproj", "entrypoint|host_project|Core|web host"),
        node("unrelated", "Entrypoint", "app.MapGet(z)", "Core", "src/Core/Z.cs", "entrypoint|aspnet_route||app.MapGet(z)"),
        node("other host", "Entrypoint", "App", "App", "src/App/App.csproj", "entrypoint|host_project|App|web host"),
    ]
    found = impact.sections(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame([], schema.EDGES), "WeatherService")
    got = [(r.id, r.total) for r in found.where("section = 'entrypoint'").collect()]
    assert sorted(got) == [("host", 3), ("named", 3), ("same file", 3)]
