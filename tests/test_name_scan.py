"""Many names in many texts: equal to a loop over all pairs, by built-in functions, one automaton, or several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import facts, name_scan


def tables():
    rng = random.Random(4)
    alphabet = "aAbBéßſİ. "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(120)] + [None, "", "ab" * 40_000, texts_end := "AB.ba"]
    wanted = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(150)] + [None, "", "nowhere", texts_end, "ab", "AB"]
    return [(i // 2, t) for i, t in enumerate(texts)], wanted


def brute(texts, wanted):
    folded = {names.fold_text(w) for w in wanted if w}
    return sorted((k, w) for k, t in texts if t is not None for w in folded if w in names.fold_text(t))


@pytest.mark.parametrize("block, few, take", [(4 << 20, 8, 1000), (700, 8, 1000), (4 << 20, 8, 6), (4 << 20, 0, 6), (4 << 20, 8, 0)])
def test_against_all_pairs(spark, monkeypatch, block, few, take):
    monkeypatch.setattr(name_scan, "BLOCK_BYTES", block)
    monkeypatch.setattr(name_scan, "FEW", few)
    texts, wanted = tables()
    rows, own = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(w,) for w in wanted[:take]], "name string")
    got = name_scan.names_held(rows, F.col("t"), own, ["k"])
    assert sorted(map(tuple, got.collect())) == brute(texts, wanted[:take])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert name_scan.names_held(rows.limit(0), F.col("t"), own, ["k"]).isEmpty()


def test_a_map_of_many_names(spark):
    rows = spark.createDataFrame([("t/ParcelTests.cs", 1, "new Parcel()"), ("t/ParcelTests.cs", 2, "chute, parcel"), ("t/Other.cs", 1, "x"), ("t/BigChuteTest.cs", 1, None)], "path string, line int, text string")
    few = facts.test_map(rows, ["Chute", "Parcel", "PARCEL", ""])
    many = facts.test_map(rows, ["Chute", "Parcel", *[f"absent{i}" for i in range(20)]])
    want = [("t/BigChuteTest.cs", 60, "file-contains:Chute", 0), ("t/ParcelTests.cs", 120, "file:Parcel,content:2", 2)]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
