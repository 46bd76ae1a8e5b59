"""Quality rules against SQL and a plain version, labelled rows, edge rows."""

import math
import re
import zlib
from collections import Counter

from oracle import assert_same
from pyspark.sql import functions as F

from graphloom.llm import quality_rules, registry

WORD = re.compile(quality_rules.WORD)


def plain(docs, trusted):
    def features(text):
        w = WORD.findall(text or "")
        return [zlib.crc32(x.encode()) % 65536 for x in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]

    raw, good = Counter(), Counter()
    for i, text in docs:
        raw.update(features(text))
        good.update(features(text) if i in trusted else [])
    s, t, out = sum(raw.values()), sum(good.values()), []
    for i, text in docs:
        text = text or ""
        w, f = WORD.findall(text), features(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
        weight = sum(math.floor(1000 * math.log((good[b] + 5) / (raw[b] * t / s + 5))) for b in f)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(f), weight, failed, not failed and weight >= -120 * len(f)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_features", "weight", "base_failed", "kept"]


def test_query_against_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", registry.QUERIES["op13_quality_rules"], registry.ORACLES["op13_quality_rules"])


def test_odd_rows_against_plain_version(spark, odd_docs):
    texts = ["a b c a b c", "a b c d a b", "x " * 60, "x\n" * 60, "one two three " * 20 + "end", "<a> #b $c | *", "é ñ " * 60, " ", " ".join(f"w{i}" for i in range(70)), "w1 w2\nw1 w2\n \n \nw1 w2 "]
    docs = odd_docs.unionByName(spark.createDataFrame([(400 + i, t, *[None] * 12) for i, t in enumerate(texts)], odd_docs.schema))
    for trusted in ([408, 408, 3, None, 999], []):
        ids = spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, text int")
        got = quality_rules.quality_rules(docs, ids)
        assert tuple(got.columns) == quality_rules.OUT
        assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], {i for i in trusted if i is not None})
        assert all(abs(r.log_ratio - (r.weight / r.n_features / 1000 if r.n_features else 0)) < 1e-12 for r in got.collect())


def test_labelled_rows(spark):
    """Junk goes and good texts stay, those of held-out ids too."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").withColumn("own", quality_rules.held_out(F.col("doc_id")))
    rows = registry.QUERIES["op13_quality_rules"](spark, sf).where("not base_failed").join(labels, "doc_id").groupBy("own", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r.own, r.quality) for r in rows} == {(a, b) for a in (True, False) for b in (0, 1)}
    assert all(r.kept >= 0.99 if r.quality else r.kept <= 0.02 for r in rows)


def test_native(spark, monkeypatch):
    """The stored rows come from one pass over the texts, without Python and without a shuffle."""
    plans = []
    monkeypatch.setattr(quality_rules, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    registry.QUERIES["op13_quality_rules"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and not any(word in plans[0] for word in ("Python", "Arrow", "Exchange"))


def test_empty(spark, no_docs):
    assert quality_rules.quality_rules(no_docs, spark.createDataFrame([], "doc_id long")).count() == 0
