"""Toxicity and quality: held-out accuracy, the effect of the swap penalty, edge rows."""

import zlib

import numpy as np
import pytest

from graphloom.llm import quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def held_out_share(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = registry.QUERIES[query](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    return sum(own) / len(own)


def test_held_out_accuracy(spark):
    assert held_out_share(spark, "op3_toxicity", "toxic") >= 0.95
    assert held_out_share(spark, "op10_quality", "quality") >= 0.95


def test_small_label_sets_give_a_model(spark):
    """The cut of features grows with the rows: at the smallest scale they have weights too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.weights) > 50
    rows = toxicity.scored(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) >= 0.95 and np.mean([r.score >= 0.5 for r in rows if r.toxic]) >= 0.8


LABELLED = [("the women are here today", 0), ("a quiet day for men", 0), ("you worthless scum women", 1), ("worthless women go away scum", 1), ("nice weather and calm seas", 0), ("scum and worthless words", 1), ("women are worthless scum again", 1), ("a calm and pleasant talk", 0)] * 12


def gap(swap_weight):
    """How far naming a group moves the logit of a neutral sentence."""
    names = sorted({f for t, _ in LABELLED for w in toxicity.words_of(t) for f in toxicity.features_of(w) if f.startswith("=")} | {"=men", "=girls", "=people"})
    number = {f: i for i, f in enumerate(names)}
    sets = [(y, toxicity.feature_numbers(t, number)) for t, y in LABELLED]
    swapped = [(*k, n) for k, n in toxicity.swap_changes([t for t, _ in LABELLED], number).items()]
    weights, constant = toxicity.fit_logistic(sets, swapped, len(names), swap_weight)
    model = toxicity.ToxicityModel(dict(zip(names, weights.tolist())), constant, f"test-{swap_weight}")
    a, b, toxic = model.scores(["we met some women", "we met some people", "worthless scum"])
    assert toxic > 0.5
    return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))


def test_swaps_reduce_the_effect_of_naming_a_group():
    assert gap(20.0) < 0.3 * gap(0.0)
    assert ("women are here", "people are here") in toxicity.rewritings("women are here") and len(toxicity.rewritings("women are here")) == 4


def test_swaps_of_sentences():
    assert toxicity.swaps("") == [] and {(a, b) for _, a, b in toxicity.swaps("Women, here!")} == {("women", b) for b in ("men", "girls", "boys", "people")}
    put_in = toxicity.swaps("nothing named. nor here")
    assert {frozenset(rest) for rest, _, _ in put_in} == {frozenset({"nothing", "named"}), frozenset({"nor", "here"})}


def test_the_penalty_acts_on_the_query_s_own_data(spark):
    """Without it, names that share runs of characters with insults raise the score of a neutral sentence; with it they don't."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean = [r.text for r in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    names = [w for _, own in toxicity.IDENTITY for w in own]
    moved, wrong = {}, {}
    for weight in (0.0, toxicity.SWAP_WEIGHT):
        model = toxicity.fit(docs, labels, swap_weight=weight)
        logit = [np.log(s / (1 - s)) for s in np.clip(model.scores(["", *[f"the {w} came" for w in names]]), 1e-12, 1 - 1e-12)]
        moved[weight] = max(abs(x - logit[0]) for x in logit[1:])
        scores = model.scores([f"{t[:60]} {w}" for t in clean for w in names])
        wrong[weight] = float((scores >= 0.5).mean())
    assert moved[0.0] > 0.2 and moved[toxicity.SWAP_WEIGHT] < 0.5 * moved[0.0]
    assert wrong[toxicity.SWAP_WEIGHT] <= wrong[0.0] and wrong[toxicity.SWAP_WEIGHT] < 0.01


@pytest.mark.parametrize("labelled", [[], [(3, 1)], [(3, 1), (4, 0), (5, 1), (8, 0), (None, 1), (6, None), (6, 1)]])
def test_edge_rows(spark, odd_docs, no_docs, labelled):
    labels = spark.createDataFrame([(i, q, q) for i, q in labelled], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.fit(odd_docs, labels)
        got = module.scored(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert module.scored(no_docs, module.fit(no_docs, labels)).count() == 0
    kept = quality.accepted(odd_docs, quality.fit(odd_docs, labels))
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


def test_quality_moments(spark, odd_docs):
    rows = odd_docs.where("doc_id is not null").selectExpr("coalesce(text, '') as text", "cast(doc_id % 2 as int) as y")
    x, y = quality._matrix([r.text for r in rows.collect()]), np.array([r.y for r in rows.collect()])
    for label, (n, total, products) in quality.moments(rows).items():
        own = x[y == label]
        assert n == len(own) and np.allclose(total, own.sum(0)) and np.allclose(products, own.T @ own)
