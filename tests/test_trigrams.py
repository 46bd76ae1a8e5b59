"""Search by trigram postings: the rows of a scan, and how few rows it reads."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import names
from graphloom.operators import graph, trigrams
from graphloom.plans import symbols
from graphloom.plans.workspace import Workspace

COLUMNS = ["documentation_id", "metadata_name", "display_name"]


def nodes(spark):
    rng = random.Random(6)
    words = ["Order", "Book", "straße", "Parcel", "İlk", "sorter", "Ab", "x"]
    rows = []
    for i in range(600):
        name = "".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        rows.append((f"n{i:04d}", "Method", name, "P", "p", "f.cs", i, 1, rng.choice([None, f"M:Shop.{name}"]), rng.choice([None, "", f"Shop.{name}"])))
    rows += [rows[0], (None, "Type", "OrderBook", "P", "p", "f.cs", 1, 1, None, None), ("only", "Type", "Qwertz", "P", "p", "f.cs", 1, 1, None, None), ("none", "Type", None, "P", "p", None, None, None, None, None)]
    return spark.createDataFrame(rows, schema.NODES)


@pytest.mark.parametrize("most", [trigrams.MOST_SEEDS, 3])
def test_equal_to_the_scan(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(trigrams, "MOST_SEEDS", most)
    own, path = nodes(spark), f"file://{tmp_path}/names"
    trigrams.store(own, path, COLUMNS)
    held = names.fold_ci(F.concat_ws("\n", *COLUMNS))
    for query in ("orderbook", "STRASSE", "straße", "ab", "Shop.Parcel", "nowhere", "qwertz", "Order\nBook", "İLK", ""):
        some = trigrams.may_hold(spark, path, query)
        assert sorted(some.columns) == sorted(own.columns)
        hits = lambda df: sorted(map(str, df.where(held.contains(names.fold_text(query))).select(*own.columns).collect()))  # noqa: B023, E731
        assert hits(some) == hits(own)
    plan = trigrams.may_hold(spark, path, "qwertz")
    assert sorted(str(r.id) for r in plan.collect()) == ["None", "only"]


def test_few_rows_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/names"
    trigrams.store(nodes(spark), path, COLUMNS, group_bytes=4096)
    plan = trigrams.may_hold(spark, path, "Qwertz")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PushedFilters: [Or(EqualTo(id,only),IsNull(id))]" in plan


def test_postings_are_of_blocks(spark, tmp_path):
    """Neighbours share a posting for each of their grams: far fewer postings than grams of rows, and exactly those that the rows hold."""
    path, own = f"file://{tmp_path}/names", nodes(spark)
    trigrams.store(own, path, COLUMNS)
    rows, postings = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/postings")
    of_row = {(r.id, r.block, g) for r in rows.where("id is not null").collect() for t in (r.documentation_id, r.metadata_name, r.display_name) for n in [names.fold_text(t or "")] for g in (n[i : i + 3] for i in range(len(n) - 2))}
    got = [(r.block, r.gram) for r in postings.collect()]
    assert len(got) == len(set(got)) and set(got) == {(b, g) for _, b, g in of_row}
    assert len(got) * 4 < len(of_row)
    assert {r.gram: r.n for r in spark.read.parquet(f"{path}/grams").collect()} == {r.gram: r.n for r in postings.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def test_grams_of_a_batch():
    rng = random.Random(3)
    rows = [(rng.choice([3, 4, 9 << 33]), "".join(rng.choice("ab\nß𝒳İ中") for _ in range(rng.randrange(9)))) for _ in range(300)]
    for part in (rows, rows[:1], [(1, "")], [(1, "\n\n")], [(1, "abcab")]):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part])], ["block", "text"])
        got = [tuple(x.values()) for out in trigrams._block_grams(iter([batch])) for x in out.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == {(b, line[i : i + 3]) for b, t in part for line in t.split("\n") for i in range(len(line) - 2)}


def test_empty_table(spark, tmp_path):
    trigrams.store(nodes(spark).limit(0), f"file://{tmp_path}/names", COLUMNS)
    assert trigrams.may_hold(spark, f"file://{tmp_path}/names", "order").isEmpty()


def test_workspace_searches_stored_names(spark, tmp_path):
    rows = [("a", None, "PostOrder", "Method", "Shop.Orders", "src/A.cs", 1, 0, 2, 0), ("b", None, "Cancel", "Method", "Shop.Orders", "src/A.cs", 3, 0, 4, 0), ("c", None, "PostOrder", "Method", None, "tests/B.cs", 1, 0, 2, 0)]
    own = spark.createDataFrame(rows, schema.SYMBOLS)
    ws, plain = Workspace(nodes=nodes(spark), symbols=own, edges=spark.createDataFrame([], schema.EDGES)), Workspace(symbols=own)
    ws.store_names(f"file://{tmp_path}/names")
    for query in ("Shop.Orders.PostOrder", "postorder", "Orders.Cancel", "Shop.Gone", "or", "Orders.", "Shop.Orders."):
        assert list(map(str, ws.search_symbols(query).collect())) == list(map(str, plain.search_symbols(query).select(*ws.search_symbols(query).columns).collect()))
    want = graph.ranked_symbols(nodes(spark), "Shop.Parcel", 12).collect()
    got = graph.ranked_symbols(trigrams.may_hold(spark, f"file://{tmp_path}/names/nodes", "Shop.Parcel"), "Shop.Parcel", 12)
    assert list(map(str, got.select(*nodes(spark).columns, "score", "tier").collect())) == list(map(str, want))
    assert sorted(map(str, ws.change_impact("Shop.ParcelBook").collect())) == sorted(map(str, Workspace(nodes=nodes(spark), edges=ws.edges).change_impact("Shop.ParcelBook").collect()))
    assert symbols.search_key("A.B(int)") == "B"
