"""Benchmark decontamination by the q-gram lemma.

Texts are folded: lower case, every run of characters that are neither letters nor digits one space. A benchmark item of
m characters that occurs in a document with at most e edits shares at least T = m - q + 1 - q * e of its q-grams with
that place, on diagonals (document position minus item position) at most e apart. So shared q-grams are counted in
overlapping bands of 2e + 2 diagonals, each starting e + 1 after the last; bands that reach T are verified by banded
alignment of the whole item. e is ``rate`` of the item's length, less where T would not stay positive.

Items of fewer than q characters have no q-gram; they are found where they stand exactly, as whole words.

Documents are scanned whole, in the tasks that read them, with no shuffle: rolling hashes of all q-grams, a bit table
that only q-grams of the benchmark pass, then exact postings, counted ``POSTINGS`` at a time so that repetitive texts
take time but no memory. The benchmark is dealt to blocks of at most
``BLOCK_CHARS`` characters by a count of its size; a block is broadcast, and the documents are scanned once for each.

Edge cases: null texts are empty; items without a folded character identify nothing and are left out; null item
ids are kept as null; repeated items are items of their own; of equally good places of an item the earliest is told;
empty tables give no row; further columns are ignored; a very long text is one row, scanned in memory proportional to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Q, RATE = 12, 0.06
BLOCK_CHARS = 8_000_000
POSTINGS = 1 << 20
TABLE_BITS = 21  # a table that stays in a core's cache
_FOLDED: list = []


def _folded_characters() -> np.ndarray:
    """Per character of the basic plane its lower case, or a space for what is neither letter nor digit; made once for each process."""
    if not _FOLDED:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalnum():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDED.append(table)
    return _FOLDED[0]


def fold(text: str | None) -> np.ndarray:
    """The folded text as code points. Characters beyond the basic plane count as letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _folded_characters()
    if len(points) and points.max() >> 16:
        points = np.where(points >> 16, points, table[points & 0xFFFF])
    else:
        points = table[points]
    gap = points == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    points = points[keep]
    first, last = int(len(points) > 0 and points[0] == 32), len(points) - int(len(points) > 1 and points[-1] == 32)
    return points[first : max(first, last)]


def edit_budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """At most rate * m, and such that the lemma's bound stays at 1 or more."""
    return max(0, min(int(rate * m), (m - q) // q))


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram of a folded text, by doubling."""
    h = points.astype(np.uint64) + np.uint64(1)
    if len(h) < q:
        return h[:0]
    out, done, step, base = None, 0, 1, 0x9E3779B97F4A7C15
    n = len(h) - q + 1
    while True:  # h holds hashes of step characters; out those of the first `done` characters of each gram
        if q & step:
            own = h[done : done + n]
            out = own.copy() if out is None else out * np.uint64(pow(base, step, 1 << 64)) + own
            done += step
        if done == q:
            break
        h = h[: len(h) - step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Block:
    """The postings of one block of benchmark items."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        self.q = q
        items = sorted((x for x in items if len(x[1])), key=lambda x: len(x[1]) < q)  # short ones come last
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([edit_budget(len(t), q, rate) for t in self.texts], np.int64)
        self.needed = self.sizes - q + 1 - q * self.budgets
        grams = [gram_hashes(t, q) for t in self.texts]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order] if len(grams) else np.zeros(0, np.int64)
        self.at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({int(m) for m in self.sizes if m < q}):
            own = np.flatnonzero(self.sizes == m)
            h = np.array([gram_hashes(self.texts[i], m)[0] for i in own], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[m] = h[order], own[order]
        self.table = None

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of each item found in the folded text, its best place."""
        return [*self._long_matches(text), *self._short_matches(text)]

    def _short_matches(self, text: np.ndarray):
        for m, (hashes, items) in self.short.items():
            h = gram_hashes(text, m)
            edge = np.concatenate([[True], text == 32, [True]])  # of a place: whether it begins or ends a word
            where = np.flatnonzero(edge[: len(h)] & edge[m + 1 : m + 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
            low, high = np.searchsorted(hashes, h[where]), np.searchsorted(hashes, h[where], side="right")
            found: dict[int, int] = {}
            for d, a, b in zip(where[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for i in items[a:b].tolist():
                    if i not in found and np.array_equal(text[d : d + m], self.texts[i]):
                        found[i] = d
            yield from ((i, 0, d, d + m) for i, d in sorted(found.items()))

    def _band_counts(self, where: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (item, band) and their shared q-grams, of the text's q-grams k at the places where; a slice of postings at a time."""
        n = self.last[k] - self.first[k]
        ends = np.cumsum(n)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, int(ends[-1]), POSTINGS):
            high = min(low + POSTINGS, int(ends[-1]))
            number = np.arange(low, high)
            source = np.searchsorted(ends, number, side="right")
            post = self.first[k[source]] + number - (ends[source] - n[source])
            item = self.item[post]
            own, count = np.unique((item << 32) + (where[source] - self.at[post]) // (self.budgets[item] + 1) + (1 << 24), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, count])).astype(np.int64)
        return keys, counts

    def _long_matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        if self.table is None:
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        h = gram_hashes(text, self.q)
        where = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(where):
            return []
        own = h[where]
        k = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        same = self.grams[k] == own
        where, k = where[same], k[same]
        if not len(where):
            return []
        keys, count = self._band_counts(where, k)
        below = np.searchsorted(keys, keys - 1)  # a band's diagonals are its own and those of the next
        above = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        both = np.concatenate([keys, keys - 1])
        sums = np.concatenate([count + np.where(keys[above] == keys + 1, count[above], 0), np.where(keys[below] == keys - 1, 0, count)])
        best: dict[int, tuple[int, int, int]] = {}
        for key in np.unique(both[sums >= self.needed[both >> 32]]).tolist():
            i, b = key >> 32, (key & 0xFFFFFFFF) - (1 << 24)
            if best.get(i, (1,))[0] == 0:
                continue
            e, m = int(self.budgets[i]), int(self.sizes[i])
            low = b * (e + 1)  # the band holds the diagonals low .. low + 2e + 1
            exact = _exact_place(text, self.texts[i], max(low, 0), low + 2 * e + 1)
            if exact is not None:
                best[i] = (0, exact, exact + m)  # no alignment has fewer edits
                continue
            found = banded_alignment(self.texts[i], text, low - e, low + 3 * e + 1)
            if found and found[0] <= e and (i not in best or found < best[i]):
                best[i] = found
        return [(i, *v) for i, v in sorted(best.items())]


def _exact_place(text: np.ndarray, item: np.ndarray, first: int, last: int) -> int | None:
    """The first start of the item in the text between first and last."""
    part, own, at = text[first : last + len(item)].tobytes(), item.tobytes(), -1
    while (at := part.find(own, at + 1)) >= 0:
        if at % text.itemsize == 0:
            return first + at // text.itemsize
    return None


def banded_alignment(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole of a within b on diagonals low..high; None without any."""
    far, offsets = 1 << 20, np.arange(low, high + 1)
    cost = np.where((offsets >= 0) & (offsets <= len(b)), 0, far)
    start = offsets.copy()
    steps = np.arange(len(offsets))
    for i in range(1, len(a) + 1):
        j = offsets + i  # cell (i, j) on each diagonal
        ok = (j >= 1) & (j <= len(b))
        sub = cost + np.where(ok, b[np.clip(j - 1, 0, max(len(b) - 1, 0))] != a[i - 1] if len(b) else 1, far)
        down = np.append(cost[1:] + 1, far)  # the item's character has no partner
        new = np.where(sub <= down, sub, down)
        begin = np.where(sub <= down, start, np.append(start[1:], 0))
        new = np.where((j >= 0) & (j <= len(b)), new, far)
        right = new - steps  # the text's characters have no partner
        run = np.minimum.accumulate(right)
        source = np.maximum.accumulate(np.where(right == run, steps, 0))
        better = run + steps < new
        new, begin = np.where(better, run + steps, new), np.where(better, begin[source], begin)
        cost, start = np.where((j >= 0) & (j <= len(b)), new, far), begin
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(offsets[k] + len(a))) if cost[k] < far else None


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Broadcast blocks of the items, each of about block_chars characters at most: their number follows the benchmark's size."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.char_length("text") + 16)).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield spark.sparkContext.broadcast(Block([(r.item_id, fold(r.text)) for r in own.collect()]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end (in the folded text) of each document and item found in it."""
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark):

        def scan(batches, block=block):
            for batch in batches:
                rows = [(d, block.value.ids[i], e, a, z) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for i, e, a, z in block.value.matches(fold(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in benchmark_blocks(benchmark):

        def keep(batches, block=block):
            for batch in batches:
                yield batch.filter(pa.array([not block.value.matches(fold(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
