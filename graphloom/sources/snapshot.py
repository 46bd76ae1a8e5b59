"""Graph snapshots: Parquet folders for each project behind numbered manifests, and the JSON document form.

Every row has an owner: a node its project, an edge the project of its source (else of its target), a fact its own; what no
project owns is a part of its own. A manifest names, for each part and table, the data folder that holds its rows and a digest of
them. A write compares digests and stores only the parts that differ, so refreshing one project writes one project,
however large the graph. Data folders are never changed. A manifest is committed by creating the file of the next number, which
fails where it exists: of two writers that began from the same state one fails, and nothing is lost.

Edge cases: a write that dies leaves the last manifest in place; a manifest that can't be parsed (its writer died within it) is
passed over; tables that aren't given are empty; repeated rows stay repeated; an owner of very many rows is written by several tasks.
"""

from __future__ import annotations

import json
import time
import uuid
from types import SimpleNamespace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import unpack

#: The graph's own tables, and all that a snapshot holds.
TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "project_states": schema.PROJECT_STATES}
STORED = TABLES | schema.DERIVED
SHARED = "shared"


class SnapshotConflict(RuntimeError):
    """Another writer has committed since this one began."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list:
    """(name, time of last change in ms) of what a folder holds; none where there is no folder."""
    fs, at = _files(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:-5]) for name, _ in _listed(spark, f"{path}/manifests") if name.endswith(".json") and name[:-5].isdigit()]


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}/manifests/{number:08d}.json", wholetext=True).first().value)
    except (ValueError, AttributeError, AnalysisException):
        return None


def _last(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The largest number, and the last whole manifest."""
    numbers = sorted(_numbers(spark, path), reverse=True)
    return (numbers[0] if numbers else 0), next((m for m in (_manifest(spark, path, n) for n in numbers) if m is not None), None)


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    fs, at = _files(spark, f"{path}/manifests/{number:08d}.json")
    if fs.exists(at):
        raise SnapshotConflict(f"manifest {number} of {path} exists")
    try:
        out = fs.create(at, False)
    except Exception as error:  # the file system's own error, by py4j
        raise SnapshotConflict(f"manifest {number} of {path} can't be created") from error
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def _part(owner: Column) -> Column:
    """A folder name for an owner."""
    return F.when(F.coalesce(owner, F.lit("")) == "", SHARED).otherwise(F.substring(F.sha2(owner, 256), 1, 16))


def _owned(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the part of each row."""
    out = {}
    for name, df in tables.items():
        columns = [c.split(" ")[0] for c in STORED[name].split(", ")]
        if name == "edges" and "nodes" in tables:
            owners = tables["nodes"].select("id", "owning_project_id").where("owning_project_id is not null").groupBy("id").agg(F.min("owning_project_id").alias("owner"))
            source, target = (owners.select(F.col("id").alias(f"{end}_id"), F.col("owner").alias(f"{end}_owner")) for end in ("source", "target"))
            owner = F.coalesce("source_owner", "target_owner")
            df = df.select(*columns).join(source, "source_id", "left").join(target, "target_id", "left")
        else:
            owner = F.col("owning_project_id") if name == "nodes" else F.col("project_id") if "project_id" in columns else F.lit("")
        out[name] = df.select(*columns, _part(owner).alias("part"))
    return out


def digests(owned: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    """By part and table, a digest of the rows in any order: their number and the sums of two hashes."""
    out: dict[str, dict[str, str]] = {}
    for name, df in owned.items():
        row = F.to_json(F.struct(*[c for c in df.columns if c != "part"]))
        hashes = [F.sum((F.xxhash64(F.lit(i), row) % F.lit(1 << 40)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
        for r in df.groupBy("part").agg(F.concat_ws(":", F.count("*").cast("string"), *hashes).alias("digest")).collect():  # a row for each project
            out.setdefault(r.part, {})[name] = r.digest
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str, target: str = "", options: str = "") -> list[str]:
    """Stores the parts of the tables that differ from the last snapshot's, commits a manifest, and returns those parts.

    A snapshot may be written from itself. target, options: what the graph was built of, and how.
    """
    spark, folder = next(iter(tables.values())).sparkSession, f"data-{uuid.uuid4().hex}"
    number, before = _last(spark, path)
    old = (before or {}).get("parts", {}) if (before or {}).get("version") == schema.SNAPSHOT_VERSION else {}
    owned = _owned({name: tables[name] for name in STORED if name in tables})
    now, parts, changed = digests(owned), {}, {}
    for part, own in now.items():
        for name, digest in own.items():
            held = old.get(part, {}).get(name)
            if held is None or held["digest"] != digest:
                held = {"digest": digest, "folder": folder}
                changed.setdefault(name, []).append(part)
            parts.setdefault(part, {})[name] = held
    for name, own in changed.items():
        # by project; rebalancing splits a project of very many rows
        owned[name].where(F.col("part").isin(own)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{folder}/{name}")
    _commit(spark, path, number + 1, {"version": schema.SNAPSHOT_VERSION, "target": target, "options": options, "folder": folder, "at": time.time(), "parts": parts})
    return sorted({p for own in changed.values() for p in own})


def snapshot_info(spark: SparkSession, path: str) -> SimpleNamespace | None:
    """version, target, options, parts and folder (the one that it wrote) of the last whole manifest, or None."""
    manifest = _last(spark, path)[1]
    return manifest and SimpleNamespace(**manifest)


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables, or None where there is no whole snapshot of this version."""
    info = snapshot_info(spark, path)
    if info is None or info.version != schema.SNAPSHOT_VERSION:
        return None
    out = {}
    for name, columns in STORED.items():
        held = [f"{path}/{own[name]['folder']}/{name}/part={part}" for part, own in sorted(info.parts.items()) if name in own]
        out[name] = spark.read.schema(columns).parquet(*held) if held else spark.createDataFrame([], columns)
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2, grace_hours: float = 24.0) -> list[str]:
    """Deletes the data folders that none of the last ``keep`` manifests names, and the manifests before these; returns what went.

    Folders younger than grace_hours stay: their writer may be about to commit.
    """
    numbers = sorted(_numbers(spark, path), reverse=True)
    kept = [m for m in (_manifest(spark, path, n) for n in numbers[: max(1, keep)]) if m is not None]
    used = {held["folder"] for m in kept for own in m["parts"].values() for held in own.values()}
    if not used:
        return []
    old = [f"manifests/{n:08d}.json" for n in numbers[max(1, keep) :]]
    old += [name for name, at in _listed(spark, path) if name.startswith("data-") and name not in used and at < (time.time() - 3600 * grace_hours) * 1000]
    for name in old:
        fs, at = _files(spark, f"{path}/{name}")
        fs.delete(at, True)
    return old


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in columns.split(", ")]


def read_json_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Snapshots stored as one JSON document, camel-case names, missing arrays empty."""
    kinds = {name: "array<struct<" + ", ".join(f"{_camel(c)}: {t}" for c, t in _fields(columns)) + ">>" for name, columns in TABLES.items()}
    doc = spark.read.schema(", ".join(f"{_camel(n)} {t}" for n, t in kinds.items())).option("multiLine", True).json(path)
    return {name: doc.select(F.explode(F.coalesce(_camel(name), F.array())).alias("r")).select(*[F.col(f"r.{_camel(c)}").alias(c) for c, _ in _fields(columns)]) for name, columns in TABLES.items()}


def write_json_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Rows of every table as JSON lines below path/<table>, camel-case names, nulls left out."""
    for name, df in tables.items():
        df.select(*[F.col(c).alias(_camel(c)) for c in df.columns]).write.mode("overwrite").json(f"{path}/{name}")


def unpacked(nodes: DataFrame) -> DataFrame:
    """Registration nodes with their packed documentation id as columns: lifetime, service, implementation, is_factory, is_enumerable."""
    own = nodes.where(F.col("documentation_id").startswith("di|")).withColumn("part", unpack(F.col("documentation_id")))
    part = F.col("part")
    return own.select("id", F.get(part, F.lit(1)).alias("lifetime"), F.get(part, F.lit(2)).alias("service"), F.when(F.get(part, F.lit(3)) != "", F.get(part, F.lit(3))).alias("implementation"), (F.get(part, F.lit(4)) == "factory").alias("is_factory"), (F.get(part, F.lit(5)) == "enumerable").alias("is_enumerable"))
