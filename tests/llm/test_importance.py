"""Importance resampling against SQL and a plain version; the draw's pieces."""

import hashlib
import math
import random
import re
import zlib

from oracle import assert_same
from pyspark.sql import functions as F

from graphloom.llm import importance, registry

WORD, LOWER = re.compile(importance.WORD), str.maketrans(importance.ASCII_UPPER, importance.ASCII_LOWER)


def plain(docs, aims, order=1, buckets=10_000, percent=10, min_words=20):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    own, raw, aim = [(i, *features(t)) for i, t in docs], [0] * buckets, [0] * buckets
    for counts, lists in ((raw, [f for _, _, f in own]), (aim, [features(t)[1] for t in aims])):
        for f in lists:
            for g in f:
                counts[zlib.crc32(g.encode()) % buckets] += 1
    s, t, rows = sum(raw), sum(aim), []
    for i, n_words, f in own:
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in (zlib.crc32(g.encode()) % buckets for g in f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    wanted = len(able) * percent // 100
    return sorted([(*r[:4], i + 1 if i < wanted else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < min_words], key=str)


def test_query_against_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", registry.QUERIES["op12_importance"], registry.ORACLES["op12_importance"])


def test_odd_rows_against_plain_version(spark, odd_docs):
    random.seed(4)
    more = [(100 + i, " ".join(random.choice(["red", "Blue", "grün", "K", "x1", "-"]) for _ in range(random.choice([3, 25, 60]))), *[None] * 12) for i in range(80)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    aims = [None, "", "red red X1 grün", "the red sea"]
    target = spark.createDataFrame([(i, t, 7) for i, t in enumerate(aims)], "item_id long, text string, weight long")
    for order, percent in ((1, 10), (3, 45), (1, 100)):
        got = importance.resampled(docs, target, percent, order=order)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], aims, order, percent=percent)


def test_hot_scores_are_numbered_in_pieces(spark, monkeypatch, tmp_path):
    """Ties of one score over several pieces of ids; the cutoff falls within them."""
    monkeypatch.setattr(importance, "HOT_ROWS", 10)
    monkeypatch.setattr(importance, "PIECE_IDS", 16)
    monkeypatch.setattr(importance, "BINS", 4)
    rows = [(i, 5, 1, 50 if i % 3 else 40 - i) for i in random.Random(1).sample(range(300), 300)] + [(None, 5, 1, 50)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    ordered = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0]))
    for wanted in (1, 7, 150, 201, 202, 301):
        got = [(r["rank"], r.doc_id) for r in importance.drawn(df, wanted).where("rank is not null").orderBy("rank").collect()]
        assert got == [(k + 1, r[0]) for k, r in enumerate(ordered[:wanted])]


def test_no_row_is_sorted_with_all_others(spark):
    """Windows are within a bin, a score or a piece: none is over all rows."""
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(1).cast("long").alias("weight"), (F.col("id") % 7).alias("score"))
    plan = importance.drawn(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_few_or_no_documents(spark, no_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(no_docs, target).count() == 0
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_features, r["rank"]) for r in importance.resampled(few, target).orderBy("doc_id").collect()] == [(1, 3, None), (2, 0, None)]
