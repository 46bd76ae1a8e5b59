import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import edit_counts
from graphloom.llm.chunk_encoder import ChunkEncoder, cuts_at_white_space, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["hello", "wörld", "don't", "  ", "\n", "a", "123", "!!", "\n\n", "\t", "日本", "it's", ".", "x y"]


def spliced(text, position, n, insert):
    at = min(max(position, 0), len(text))
    return text[:at] + insert + text[at + max(n, 0) :]


def tree_of(text, enc, leaf_chars=256):
    parts = edit_counts.segments(text, leaf_chars)
    return edit_counts.SegmentTree([len(p) for p in parts], enc.lengths(parts))


def check(tree, text, tokenizer):
    """Every sum is that of the children, leaves cover the text, and the root has the count of the whole text."""
    for k, (a, b) in enumerate(zip(tree.left, tree.right)):
        if a >= 0:
            assert all(c[k] == c[a] + c[b] for c in (tree.chars, tree.tokens, tree.leaves))
    assert tree.chars[0] == len(text) and tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
    at = 0
    for k in tree.own_leaves():
        assert tree.tokens[k] == len(tokenizer.encode(text[at : at + tree.chars[k]], add_special_tokens=False).ids)
        at += tree.chars[k]


def test_random_edits_against_whole_encoding():
    random.seed(5)
    tokenizer, enc = Tokenizer.from_file(PATH), encoder(PATH)
    for _ in range(60):
        text = "".join(random.choice(PIECES) + random.choice([" ", " ", "", "  "]) for _ in range(random.choice([0, 3, 50, 600])))
        tree = tree_of(text, enc, random.choice([4, 64, 256]))
        for _ in range(6):
            edit = random.randint(-2, len(text) + 3), random.choice([0, 1, 5, 40, 2000]), "".join(random.choice(PIECES) + random.choice([" ", ""]) for _ in range(random.choice([0, 1, 60])))
            got, text = tree.edit(text, *edit, enc), spliced(text, *edit)
            assert got == text
            check(edit_counts.SegmentTree.stored(tree.arrays()), text, tokenizer)


def test_edits_touch_their_region_only():
    enc, text = encoder(PATH), "some words and more " * 5000
    tree = tree_of(text, enc)
    counts = dict(enumerate(tree.tokens))
    tree.edit(text, 50_000, 3, "new", enc)
    assert tree.reencoded < 600 and sum(tree.tokens[k] != n for k, n in counts.items()) <= 12  # one path of 391 leaves


def test_a_tree_stays_flat_and_leaves_stay_short():
    tokenizer, enc, text = Tokenizer.from_file(PATH), encoder(PATH), "start"
    tree = tree_of(text, enc)
    for i in range(300):  # always at the same place
        text = tree.edit(text, 5, 0, f" and then number {i} " * 20, enc)
    check(tree, text, tokenizer)

    def depth(k):
        return 0 if tree.left[k] < 0 else 1 + max(depth(tree.left[k]), depth(tree.right[k]))

    assert depth(0) <= 2.5 * (tree.leaves[0]).bit_length()
    for unspaced in ("abc123.def(ghi)" * 1000, "日本語、" * 2000, "line\n" * 3000):
        own = tree_of(unspaced, enc)
        assert own.leaves[0] > 10 and max(own.chars[k] for k in own.own_leaves()) < 600
        check(own, unspaced, tokenizer)


def test_operator(spark, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    edits = spark.createDataFrame([(6, 1, 5, 4, "changed "), (6, 0, 0, 0, None), (3, 2, 10**9, 0, " tail"), (None, 0, 0, 1, "X"), (77, 0, 0, 0, "nowhere")], edit_counts.EDITS)
    state = edit_counts.count_tokens(odd_docs, PATH)
    got = edit_counts.apply_edits(state, edits, PATH).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.n_after == r.tree.tokens[0] == len(tokenizer.encode(r.text, add_special_tokens=False).ids) and r.tree.chars[0] == len(r.text)
    assert {r.text for r in got if r.doc_id == 6} == {"same changed  here\nand a line of more than forty characters, many times over"}
    assert edit_counts.apply_edits(edit_counts.count_tokens(no_docs, PATH), edits, PATH).count() == 0


def test_query(spark):
    rows = edit_counts.op6_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for r in rows:
        text = texts[r.doc_id]
        n = len(text)
        after = spliced(spliced(spliced(text, n // 2, 0, f" [note {r.doc_id}]"), n // 3, 10, "Rewritten\n"), 1 << 40, 0, " the end")
        assert (r.n_tokens, r.n_tokens_edited) == tuple(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, after))


def test_encoder_against_library(tmp_path):
    """Odd white space, contractions, added tokens, and a cache so small that it turns over all the time."""
    import json

    random.seed(8)
    odd = PIECES + ["<|endoftext|>", "\x1c", "\u3000", "\xa0", "'s", " \n", "\r\n", "...", "foo,", "\x85", "ª", "don't."]
    tokenizer, enc = Tokenizer.from_file(PATH), ChunkEncoder(PATH, limit=5)
    for _ in range(3000):
        text = "".join(random.choice(odd) + random.choice(["", " ", "", "\n"]) for _ in range(random.choice([0, 1, 2, 5, 12])))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids and enc.lengths([text]) == [len(ids)]
    settings = json.load(open(PATH, encoding="utf-8"))
    assert cuts_at_white_space(settings)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "a b"}])):
        assert not cuts_at_white_space(settings | {key: value})
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(settings | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    enc = ChunkEncoder(str(other))
    assert not enc.in_chunks and enc.encode(["Hello  World"]) == ChunkEncoder(PATH).encode(["hello  world"])
