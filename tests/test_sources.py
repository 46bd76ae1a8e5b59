"""Files, snapshots, packed fields and stored tables."""

import shutil

from pyspark.sql import functions as F

from graphloom import schema, storage
from graphloom.functions import names
from graphloom.sources import snapshot, tables, text


def test_files_with_odd_names(spark, tmp_path):
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "a b+c" / "x 1.cs").write_text("one\ntwo")
    (tmp_path / "obj").mkdir()
    (tmp_path / "obj" / "y.cs").write_text("no")
    assert [tuple(r) for r in text.read_files(spark, f"file://{tmp_path}").collect()] == [("a b+c/x 1.cs", "one\ntwo")]


def test_open_documents_and_solutions(spark):
    files = spark.createDataFrame([("a.cs", "old"), ("b.cs", "kept")], schema.FILES)
    opened = spark.createDataFrame([("a.cs", "new"), ("b.cs", ""), ("c.cs", "not on disk")], schema.FILES)
    assert {tuple(r) for r in text.with_open_documents(files, opened).collect()} == {("a.cs", "new"), ("b.cs", "kept")}
    sln = 'Project("{X}") = "App", "src\\App\\App.csproj", "{Y}"\nEndProject\n'
    slnx = '<Solution><Project Path="src/Job/Job.csproj" /></Solution>'
    own = spark.createDataFrame([("all.sln", sln), ("all.slnx", slnx), ("bad.slnx", "<Solution>")], schema.FILES)
    assert {r.path for r in text.solution_projects(own).collect()} == {"src/App/App.csproj", "src/Job/Job.csproj"}


def test_a_malformed_project_file_is_an_empty_project(spark):
    own = spark.createDataFrame([("a/A.csproj", "<Project><Broken>"), ("b/B.csproj", '<Project Sdk="S" />'), ("c/C.csproj", None)], schema.FILES)
    assert {(r.name, r.sdk or "", r.type) for r in text.read_projects(own).collect()} == {("A", "", "classlib"), ("B", "S", "classlib"), ("C", "", "classlib")}


def test_snapshots_are_never_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    nodes = spark.createDataFrame([("n1", "Type")], "id string, kind string").select(*[F.col(c) if c in ("id", "kind") else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.NODES.split(", "))])
    edges = spark.createDataFrame([("calls", "a", "b")], schema.EDGES)
    assert snapshot.read_snapshot(spark, path) is None
    snapshot.write_snapshot({"nodes": nodes, "edges": edges}, path, target="all.sln")
    first = snapshot.read_snapshot(spark, path)
    assert first["edges"].count() == 1 and first["project_states"].count() == 0
    snapshot.write_snapshot({"nodes": first["nodes"], "edges": first["edges"].unionByName(spark.createDataFrame([("calls", "c", "d")], schema.EDGES))}, path)  # from itself
    assert snapshot.read_snapshot(spark, path)["edges"].count() == 2 and first["edges"].count() == 1
    folder = snapshot.snapshot_info(spark, path).folder
    shutil.copytree(tmp_path / "graph" / folder, tmp_path / "graph" / "data-torn")  # a write that died before its manifest
    assert snapshot.snapshot_info(spark, path).folder == folder


def test_json_snapshots(spark, tmp_path):
    states = spark.createDataFrame([("p", "P", "p.csproj", "f", ["q"])], schema.PROJECT_STATES)
    snapshot.write_json_snapshot({"project_states": states}, f"file://{tmp_path}/j")
    row = spark.read.json(f"file://{tmp_path}/j/project_states").first()
    assert (row.projectId, row.referencedProjectIds) == ("p", ["q"])


def test_packed_fields_may_hold_bars(spark):
    rows = spark.createDataFrame([("a|b", "c\\p", "\\s|"), ("", "x", "y")], "a string, b string, c string")
    back = rows.select("a", "b", "c", names.unpack(names.pack(F.col("a"), F.col("b"), F.col("c"))).alias("u")).collect()
    assert all(r.u == [r.a, r.b, r.c] for r in back)


def test_stored_tables_follow_their_input(spark, tmp_path):
    for t in tables.GRAPH_TABLES:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    before = tables.nodes(spark, str(tmp_path)).where("kind = 'Project'").count()
    spark.read.parquet(f"{tmp_path}/region.parquet").where("r_regionkey < 3").coalesce(1).write.parquet(f"{tmp_path}/few")
    part = next((tmp_path / "few").glob("part-*.parquet"))
    shutil.copyfile(part, tmp_path / "region.parquet")
    (tmp_path / ".region.parquet.crc").unlink(missing_ok=True)
    assert (before, tables.nodes(spark, str(tmp_path)).where("kind = 'Project'").count()) == (5, 3)


def test_clear_deletes_what_was_written(spark):
    kept = storage._WRITTEN.pop(spark.sparkContext.applicationId, [])
    df = storage.materialize(spark.range(3), "three")
    assert df.count() == 3 and storage.clear(spark) == 1 and storage.clear(spark) == 0
    storage._WRITTEN[spark.sparkContext.applicationId] = kept


def test_scratch_keeps_what_it_is_told_to(spark):
    with storage.scratch(spark) as keep:
        gone = storage.materialize(spark.range(2), "gone")
        kept = keep(gone.where("id = 1"), "kept")
        paths = storage._WRITTEN[spark.sparkContext.applicationId][-2:]
    assert kept.count() == 1 and paths[1] in storage._WRITTEN[spark.sparkContext.applicationId] and paths[0] not in storage._WRITTEN[spark.sparkContext.applicationId]
