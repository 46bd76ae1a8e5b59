import random

import numpy as np

from graphloom.llm import decontaminate as dc


def plain_edits(item, text):
    """Fewest edits of the whole item against any part of text."""
    cost = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(cost)
        new[0] = i
        for j in range(1, len(text) + 1):
            new[j] = min(cost[j - 1] + (text[j - 1] != c), cost[j] + 1, new[j - 1] + 1)
        cost = new
    return int(cost.min())


def as_text(points):
    return "".join(map(chr, points))


def test_edited_items_against_brute_force():
    random.seed(9)
    letters = "abcdefgh "
    items = [(k, dc.fold("".join(random.choice(letters) for _ in range(random.choice([40, 90, 200]))))) for k in range(6)]
    block = dc.Block(items)
    for _ in range(60):
        k, item = random.choice(items)
        own = list(as_text(item))
        for _ in range(random.randint(0, 2 * dc.edit_budget(len(item)))):
            at = random.randrange(len(own))
            own[at : at + random.choice([0, 1])] = random.choice(["", "x", "y"])
        text = dc.fold("".join(random.choice(letters) for _ in range(60)) + "".join(own) + "".join(random.choice(letters) for _ in range(60)))
        got = {block.ids[i]: e for i, e, _, _ in block.matches(text)}
        for j, other in items:
            e = plain_edits(other, text)
            assert got.get(j) == (e if e <= dc.edit_budget(len(other)) else None)


def test_operator(spark, odd_docs, no_docs):
    item = "The Quick brown fox jumps over the lazy dog, and then it sleeps for a very long time."
    benchmark = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "short", "x"), (None, "A second item that is long enough to be found in a text by itself", "x")], "item_id long, text string, doc_id string")
    more = [(200, f"Before. {item.upper().replace(' ', chr(10))} After"), (201, item[: len(item) // 2]), (202, item.replace("fox", "cat") + " " + item), (203, "x a second item that is long enough to be found in a text by itself y"), (204, None)]
    docs = odd_docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*r, 1.0) for r in more], "doc_id long, text string, score double"))
    assert {(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, benchmark).collect()} == {(200, 1, 0), (202, 1, 0), (203, None, 0)}
    kept = dc.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert dc.contaminated(no_docs, benchmark).count() == 0 and dc.clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_short_items_are_whole_words():
    block = dc.Block([(k, dc.fold(t)) for k, t in enumerate(["Cat", "a cat", "!!", "", "twelve chars", "eleven char", "a"])])
    got = lambda text: {block.ids[i]: (e, a, z) for i, e, a, z in block.matches(dc.fold(text))}
    assert got("The cat; concat a CAT.") == {0: (0, 4, 7), 1: (0, 15, 20), 6: (0, 15, 16)}
    assert got("cat") == {0: (0, 0, 3)} and got("scat cats") == {} and got("") == {}
    assert got("these twelve chars") == {4: (0, 6, 18)} and got("eleven char") == {5: (0, 0, 11)} and got("eleven chars") == {}


def test_repetitive_texts_are_counted_in_slices(monkeypatch):
    items = [(1, dc.fold("ab" * 40)), (2, dc.fold("a" * 60)), (3, dc.fold("xyz " * 20))]
    texts = [dc.fold(t) for t in ("ab" * 300, "a" * 500, "b" + "ab" * 39 + "c", "xyz xyz " * 40, "a" * 59)]
    whole = [dc.Block(items).matches(t) for t in texts]
    monkeypatch.setattr(dc, "POSTINGS", 97)
    assert [dc.Block(items).matches(t) for t in texts] == whole
    for t, found in zip(texts, whole):
        assert {i: e for i, e, _, _ in found} == {i: plain_edits(t2, t) for i, (_, t2) in enumerate(items) if plain_edits(t2, t) <= dc.edit_budget(len(t2))}
    assert whole[0][0][2] == 0 and whole[3][0][2] == 0  # of equal places the earliest


def test_benchmark_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, dc.contaminated(docs, benchmark).collect()))
    texts = {r.doc_id: as_text(dc.fold(r.text)) for r in docs.collect()}
    exact = {(d, r.item_id) for r in benchmark.collect() for d, t in texts.items() if as_text(dc.fold(r.text)) in t}
    assert exact and exact == {r[:2] for r in whole if r[2] == 0}
    blocks = list(dc.benchmark_blocks(benchmark, 2000))
    assert len(blocks) > 3 and sum(len(b.value.ids) for b in blocks) == benchmark.count()
