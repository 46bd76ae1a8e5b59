import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import token_output
from graphloom.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, end_id=2):
    """Per row in ascending order of id (null first, then text): id, start, number of ids, crc32."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_against_library(spark, odd_docs):
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    got = token_output.token_output(odd_docs, PATH, 2).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_small_shards_round_trip(spark, odd_docs):
    path = fresh_path(spark, "shards")
    token_output.write_shards(odd_docs, path, PATH, 2, shard_ids=5)
    records = token_output.read_records(spark, path)
    assert records.count() == odd_docs.count()
    index = token_output.build_index(records, 3)
    located = token_output.look_up(index, spark.createDataFrame([(4, 0), (3, 2), (None, 1), (99, 0), (3, 3)], "doc_id long, occurrence long"), 3)
    tokenizer = Tokenizer.from_file(PATH)
    got = {(r.doc_id, r.occurrence): tokenizer.decode(r.ids[:-1]) for r in token_output.fetch_ids(spark, path, located).collect()}
    assert got == {(4, 0): "One", (3, 2): "one", (None, 1): "no id"}  # keys that aren't there give no row


def test_perfect_hash_is_minimal():
    for n in (1, 2, 5, 1000, 20_000):
        h = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.int64)).astype(np.uint64)
        assert sorted(token_output.find_slots(h, token_output.minimal_perfect_hash(h), len(h)).tolist()) == list(range(len(h)))


def test_empty(spark, no_docs):
    assert token_output.token_output(no_docs, PATH, 2).count() == 0


def test_an_index_that_misplaces_keys_is_no_silent_loss(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(token_output, "look_up", lambda index, keys, parts: keys.where("doc_id <> 7").selectExpr("doc_id", "occurrence", "0L as shard", "0L as offset", "1L as n_tokens"))
    with pytest.raises(ValueError, match="of 20 documents"):
        token_output.token_output(docs, PATH, 2)


def test_batches_become_python_texts_piece_by_piece():
    texts = ["", "é" * 3, "a" * 50, None, *("b" * n for n in range(30)), "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(token_output.pieces([batch.slice(0, 0), batch, batch.slice(2, 5)], 40))
    assert [p for keys, own in got for p in zip(keys, own)] == [*enumerate(texts), *list(enumerate(texts))[2:7]]
    assert all(len(own) == 1 or sum(len((t or "").encode()) for t in own) <= 40 for _, own in got)
