"""Edit-aware token counts: a segment tree of pre-token segments per document, updated where edits touch it.

A text is cut into segments of about ``LEAF_CHARS`` characters where a byte-level BPE pre-tokenizer always cuts too:
before white space that follows a non-space, or, where no such place comes soon, between ASCII or CJK letters, digits
and punctuation marks other than the apostrophe. So segment counts add up to the count of the text. Leaves hold a segment's
characters and tokens, inner nodes the sums of their two children.

An edit (position, characters to delete, text to insert) descends by character sums to the leaves it touches. Where it
changed the characters at a cut so that the cut is no longer sure, the leaf beyond joins as boundary context. That region
alone is encoded and cut again; its leaves are replaced in place (a leaf that splits becomes a small subtree, an emptied
one gives its parent to its sibling) and the sums above are refreshed. A subtree grown lopsided is rebuilt, so the tree
stays logarithmic whatever the edits. All else keeps its counts.

The state is a table (doc_id, text, tree), where tree holds the nodes as arrays, so that trees live on between edits and a
load costs no encoding. Documents are independent: a task holds one batch of them.

Edge cases: null text is empty (one empty leaf, 0 tokens); a null id and repeated ids keep their rows, and each row of
an id gets the edits of the id; edits apply in order of seq, ties by position, deletion and inserted text; positions beyond
the text are at its end, negative ones at its start; null inserted text is empty; an empty table gives no row; further
columns are ignored. A very long text is a tree of more leaves; a very long pre-token (a run of one kind of character) is
one leaf, as it is one piece to the tokenizer too. With a tokenizer that isn't cut at white space (see chunk_encoder)
each text is one leaf.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import ChunkEncoder, encoder, in_batches
from .common import id_and_text, read

LEAF_CHARS = 256
_WHITE = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS, _MARKS = "A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5", "!-&(-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1f"
_KINDS = [(a, b) for a in (_LETTERS, "0-9", _MARKS) for b in (_LETTERS, "0-9", _MARKS) if a != b]
_SPACE_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_ANY_CUT = re.compile("|".join([_SPACE_CUT.pattern, *[f"(?<=[{a}])(?=[{b}])" for a, b in _KINDS]]))
TREE = ("left", "right", "chars", "tokens", "leaves")
STATE = f"doc_id long, text string, tree struct<{','.join(f'{c}:array<int>' for c in TREE)}>"
_TREE_TYPE = pa.struct([(c, pa.list_(pa.int32())) for c in TREE])
EDITS = "doc_id long, seq long, position long, n_delete long, insert string"


def is_cut(text: str, at: int) -> bool:
    """Whether encoding always cuts at this offset of the text."""
    return not 0 < at < len(text) or _ANY_CUT.match(text[at - 1 : at + 1], 1) is not None


def segments(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Segments of leaf_chars characters or more (the last may be shorter), cut where encoding cuts too."""
    out, start, size = [], 0, len(text)
    while start < size:
        cut = _SPACE_CUT.search(text, start + leaf_chars, start + 2 * leaf_chars) or _ANY_CUT.search(text, start + leaf_chars)
        end = cut.start() if cut else size
        out.append(text[start:end])
        start = end
    return out or [""]


class SegmentTree:
    """Node k has the children left[k] and right[k] (-1: a leaf) and of what is below it the sums chars[k], tokens[k], leaves[k].

    Node 0 is the root. Nodes without leaves are spare.
    """

    def __init__(self, sizes: list[int], counts: list[int]):
        self.left, self.right, self.chars, self.tokens, self.leaves = [], [], [], [], []
        self.spare: list[int] = []
        self.reencoded, self._lopsided = 0, -1
        self._build(self._node(), list(zip(sizes, counts)))

    @classmethod
    def stored(cls, tree: dict) -> SegmentTree:
        self = cls.__new__(cls)
        for c in TREE:
            setattr(self, c, list(tree[c]))
        self.spare = [k for k, n in enumerate(self.leaves) if not n]
        self.reencoded, self._lopsided = 0, -1
        return self

    def arrays(self) -> dict:
        return {c: getattr(self, c) for c in TREE}

    @property
    def total(self) -> int:
        return self.tokens[0]

    def _node(self) -> int:
        if self.spare:
            return self.spare.pop()
        for c in (self.left, self.right):
            c.append(-1)
        for c in (self.chars, self.tokens, self.leaves):
            c.append(0)
        return len(self.left) - 1

    def _free(self, at: int) -> None:
        self.left[at] = self.right[at] = -1
        self.chars[at] = self.tokens[at] = self.leaves[at] = 0
        self.spare.append(at)

    def _sum(self, at: int) -> None:
        a, b = self.left[at], self.right[at]
        self.chars[at], self.tokens[at] = self.chars[a] + self.chars[b], self.tokens[a] + self.tokens[b]
        self.leaves[at] = n = self.leaves[a] + self.leaves[b]
        if 4 * max(self.leaves[a], self.leaves[b]) > 3 * n + 8:
            self._lopsided = at

    def _build(self, at: int, own: list[tuple[int, int]]) -> None:
        """Makes the node a balanced tree of these leaves (characters, tokens)."""
        if len(own) == 1:
            self.left[at] = self.right[at] = -1
            self.chars[at], self.tokens[at], self.leaves[at] = *own[0], 1
            return
        half = len(own) // 2
        self.left[at], self.right[at] = a, b = self._node(), self._node()
        self._build(a, own[:half])
        self._build(b, own[half:])
        self._sum(at)

    def own_leaves(self, at: int = 0) -> list[int]:
        """The leaf nodes below a node, in order."""
        out, todo = [], [at]
        while todo:
            k = todo.pop()
            if self.left[k] < 0:
                out.append(k)
            else:
                todo += (self.right[k], self.left[k])
        return out

    def _rebuild(self, at: int) -> None:
        own, todo = [(self.chars[k], self.tokens[k]) for k in self.own_leaves(at)], [self.left[at], self.right[at]]
        while todo:
            k = todo.pop()
            if self.left[k] >= 0:
                todo += (self.left[k], self.right[k])
            self._free(k)
        self._build(at, own)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """Start and end of the leaf that holds the character at position."""
        at, start = 0, 0
        while self.left[at] >= 0:
            before = self.chars[self.left[at]]
            if position - start < before:
                at = self.left[at]
            else:
                start, at = start + before, self.right[at]
        return start, start + self.chars[at]

    def _replace(self, at: int, start: int, low: int, high: int, new: list) -> None:
        """Puts the leaves new in the place of those that cover low..high; the first of them takes all, and new is empty then."""
        a, b = self.left[at], self.right[at]
        if a < 0:
            own = new[:] or [(0, 0)]
            new.clear()
            self._build(at, own)
            return
        middle = start + self.chars[a]
        if low < middle:
            self._replace(a, start, low, high, new)
        if high > middle:
            self._replace(b, middle, low, high, new)
        if self.chars[a] and self.chars[b]:
            self._sum(at)
            return
        stays, goes = (b, a) if not self.chars[a] else (a, b)
        for c in (self.left, self.right, self.chars, self.tokens, self.leaves):
            c[at] = c[stays]
        self._free(stays)
        self._free(goes)

    def edit(self, text: str, position: int, n_delete: int, insert: str, enc: ChunkEncoder) -> str:
        """text: what the tree stands for. Returns the edited text; the tree then stands for that."""
        size = len(text)
        position = min(max(position, 0), size)
        n_delete = min(max(n_delete, 0), size - position)
        new = text[:position] + insert + text[position + n_delete :]
        grown, last = len(new) - size, max(size - 1, 0)
        low = self.leaf_at(min(position, last))[0]
        high = self.leaf_at(min(position + max(n_delete, 1) - 1, last))[1]
        while low > 0 and not is_cut(new, low):
            low = self.leaf_at(low - 1)[0]
        while high < size and not is_cut(new, high + grown):
            high = self.leaf_at(high)[1]
        region = new[low : high + grown]
        parts = (segments(region) if enc.in_chunks else [region]) if region else []
        self.reencoded += len(region)
        self._lopsided = -1
        self._replace(0, 0, low, high, list(zip(map(len, parts), enc.lengths(parts))))
        if self._lopsided >= 0:
            self._rebuild(self._lopsided)
        return new


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The state of documents never seen before: doc_id, text, tree."""

    def apply(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts, trees = batch.column(1).to_pylist(), []
            for a, b in in_batches(texts):
                cut = [segments(t) if enc.in_chunks else [t] for t in texts[a:b]]
                flat = iter(enc.lengths([p for parts in cut for p in parts]))
                for parts in cut:
                    trees.append(SegmentTree([len(p) for p in parts], [next(flat) for _ in parts]).arrays())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, _TREE_TYPE)], ["doc_id", "text", "tree"])

    return id_and_text(docs).mapInArrow(apply, STATE)


def apply_edits(state: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """The state after the edits (doc_id, seq, position, n_delete, insert), with n_before, n_after and n_reencoded characters.

    Edits are gathered by document and meet the state in one join.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "position", "n_delete", F.coalesce("insert", F.lit("")).alias("insert"))))
    own = edits.select(F.col("doc_id").alias("edited_id"), "seq", "position", "n_delete", "insert").groupBy("edited_id").agg(order.alias("edits"))
    return edited(state.join(own, F.col("doc_id").eqNullSafe(F.col("edited_id")), "left").drop("edited_id"), tokenizer)


def edited(state: DataFrame, tokenizer: str) -> DataFrame:
    """As apply_edits, where state already has the column edits."""

    def apply(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts, trees, before, after, regions = [], [], [], [], []
            for text, stored, edits in zip(*[batch.column(c).to_pylist() for c in ("text", "tree", "edits")]):
                tree = SegmentTree.stored(stored)
                before.append(tree.total)
                for e in edits or ():
                    text = tree.edit(text, e["position"] or 0, e["n_delete"] or 0, e["insert"] or "", enc)
                texts.append(text)
                trees.append(tree.arrays())
                after.append(tree.total)
                regions.append(tree.reencoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(trees, _TREE_TYPE), *[pa.array(x, pa.int64()) for x in (before, after, regions)]],
                ["doc_id", "text", "tree", "n_before", "n_after", "n_reencoded"],
            )

    return state.select("doc_id", "text", "tree", "edits").mapInArrow(apply, f"{STATE}, n_before long, n_after long, n_reencoded long")


def routine_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of each text: a note put in its middle, ten characters after its first third replaced, an ending added."""
    size = F.char_length(text).cast("long")

    def one(seq, position, n, insert):
        return F.struct(F.lit(seq).cast("long").alias("seq"), position.cast("long").alias("position"), n.cast("long").alias("n_delete"), insert.alias("insert"))

    return F.array(
        one(0, F.floor(size / 2), F.lit(0), F.concat(F.lit(" [note "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("]"))),
        one(1, F.floor(size / 3), F.lit(10), F.lit("Rewritten\n")),
        one(2, F.lit(1 << 40), F.lit(0), F.lit(" the end")),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, before and after three edits of it."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    state = count_tokens(read(spark, sf_dir, "documents"), path).withColumn("edits", routine_edits(F.col("text"), F.col("doc_id")))
    return edited(state, path).select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_after").alias("n_tokens_edited"), F.get("tree.leaves", F.lit(0)).cast("long").alias("n_segments"), "n_reencoded")
