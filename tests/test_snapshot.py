"""Copy-on-write snapshots: what a refresh writes, races of writers, torn manifests, vacuum."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.sources import snapshot


def tables(spark, **names):
    projects = {"p1": "A", "p2": "B", "p3": "C"} | names
    nodes = [("solution", "Solution", "s", None, None, None, None, None, None, None)]
    nodes += [(f"{p}:{i}", "Type", f"{n}{i}", n, p, f"{p}/f.cs", i, 1, f"T:{n}{i}", None) for p, n in projects.items() for i in range(3)]
    edges = [("contains", "solution", f"{p}:0") for p in projects] + [("calls", f"{p}:1", "p1:0") for p in projects] + [("calls", "gone", "nowhere")]
    states = [(p, n, f"{p}.csproj", n, []) for p, n in projects.items()]
    return {"nodes": spark.createDataFrame(nodes, schema.NODES), "edges": spark.createDataFrame(edges, schema.EDGES), "project_states": spark.createDataFrame(states, schema.PROJECT_STATES)}


def rows(got):
    return {name: sorted(map(str, df.collect())) for name, df in got.items() if name in snapshot.TABLES}


def folders(tmp_path):
    return {d for d in os.listdir(tmp_path / "g") if d.startswith("data-")}


def test_a_refresh_writes_the_changed_project_only(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    assert len(snapshot.write_snapshot(tables(spark), path)) == 4  # three projects and what no project owns
    first = folders(tmp_path)
    changed = tables(spark, p2="Beta")
    wrote = snapshot.write_snapshot(changed, path)
    (new,) = folders(tmp_path) - first
    assert len(wrote) == 1 and {t: os.listdir(tmp_path / "g" / new / t) for t in ("nodes", "project_states")}.keys() == {"nodes", "project_states"}
    assert {d for t in os.listdir(tmp_path / "g" / new) for d in os.listdir(tmp_path / "g" / new / t) if d.startswith("part=")} == {f"part={wrote[0]}"}
    assert "edges" not in os.listdir(tmp_path / "g" / new)  # its edges are as before
    assert rows(snapshot.read_snapshot(spark, path)) == rows(changed)
    assert snapshot.write_snapshot(snapshot.read_snapshot(spark, path), path) == [] and len(folders(tmp_path)) == 2  # from itself: nothing to write
    fewer = {name: df.where(c) for (name, df), c in zip(changed.items(), ("coalesce(owning_project_id, '') <> 'p3'", "source_id not like 'p3%' and target_id not like 'p3%'", "project_id <> 'p3'"))}
    assert snapshot.write_snapshot(fewer, path) == [] and rows(snapshot.read_snapshot(spark, path)) == rows(fewer)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/g"
    snapshot.write_snapshot(tables(spark), path)
    plain = snapshot.digests

    def slow(owned):
        monkeypatch.setattr(snapshot, "digests", plain)
        snapshot.write_snapshot(tables(spark, p1="Other"), path)  # another writer commits meanwhile
        return plain(owned)

    monkeypatch.setattr(snapshot, "digests", slow)
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.write_snapshot(tables(spark, p2="Mine"), path)
    assert rows(snapshot.read_snapshot(spark, path)) == rows(tables(spark, p1="Other"))
    snapshot.write_snapshot(tables(spark, p2="Mine"), path)  # tried again, on top of the other's
    assert rows(snapshot.read_snapshot(spark, path)) == rows(tables(spark, p2="Mine"))


def test_torn_manifests_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    for name in ("B", "C", "D", "E"):
        snapshot.write_snapshot(tables(spark, p2=name), path)
    (tmp_path / "g" / "manifests" / "00000005.json").write_text('{"version": 2, "par')
    want = rows(tables(spark, p2="E"))
    assert rows(snapshot.read_snapshot(spark, path)) == want and snapshot.snapshot_info(spark, path).target == ""
    assert snapshot.vacuum(spark, path, keep=2) == [f"manifests/0000000{n}.json" for n in (3, 2, 1)]  # data folders are too young
    gone = snapshot.vacuum(spark, path, keep=2, grace_hours=0)
    assert len(gone) == 2 and len(folders(tmp_path)) == 2 and rows(snapshot.read_snapshot(spark, path)) == want
    snapshot.write_snapshot(tables(spark, p3="Z"), path)  # goes to number 6
    assert rows(snapshot.read_snapshot(spark, path)) == rows(tables(spark, p3="Z")) and snapshot.read_snapshot(spark, path)["edges"].where(F.col("source_id") == "gone").count() == 1


def test_no_snapshot(spark, tmp_path):
    assert snapshot.read_snapshot(spark, f"file://{tmp_path}/none") is None and snapshot.vacuum(spark, f"file://{tmp_path}/none") == []
