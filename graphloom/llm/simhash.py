"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly within a Hamming radius.

Equal fingerprints become one row with the smallest document id. Two fingerprints within radius r agree in at least
b - r of b blocks of bits, so each is dealt to one bucket per choice of b - r blocks, and no link is lost. A bucket is
compared in tiles: numpy exclusive-or and bit counts over fingerprints sorted by their own bit count, skipping pairs of
tiles whose counts differ by more than the radius. A bucket of more than ``tile_rows`` rows is dealt by hash over
sub-buckets, and each pair of sub-buckets is a task group of its own, so no group exceeds twice that size. From a group
only a spanning star of each linked set is emitted (never all pairs), and the stars are joined by connected components.

Edge cases: null text is empty; no words give fingerprint 0, linked like any other; rows without an id get their
fingerprint and no component; repeated ids keep their rows; an empty table gives no row; further columns are ignored; a
very long text is hashed whole, 16,384 shingles at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, id_and_text, materialize, shuffle_partitions
from .components import connected_components

TILE = 256


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    hashes = np.fromiter([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def apply(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(apply, "doc_id long, fp long")


def blocks_for(n: int, radius: int) -> int:
    """The smallest number of blocks whose bucket keys are long enough that n random fingerprints leave about 1,000 to a bucket."""
    b = radius + 1
    while b < 2 * radius and n >> (64 * (b - radius) // b) > 1000:
        b += 1
    return b


def band_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked_stars(fp: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, smallest id) of the sets linked within the radius among fingerprints sorted by bit count."""
    n, ones, at, left, right = len(fp), np.bitwise_count(fp), np.arange(0, len(fp), TILE), [], []
    for i in at:
        a = fp[i : i + TILE]
        for j in at[at >= i]:
            if int(ones[j]) - int(ones[min(i + TILE, n) - 1]) > radius:
                break
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fp[None, j : j + TILE]) <= radius)
            keep = x + i < y + j
            left.append(x[keep] + i)
            right.append(y[keep] + j)
    x, y = np.concatenate(left), np.concatenate(right)
    if not len(x):
        return ids[:0], ids[:0]
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, x, before[y])
        np.minimum.at(root, y, before[x])
        if (root == before).all():
            break
    moved = root != ids
    return ids[moved], root[moved]


def near_links(points: DataFrame, radius: int = 4, blocks: int | None = None, tile_rows: int = 1024) -> DataFrame:
    """points (fp, rep), one row per fingerprint. Returns edges (u, v) that span every set of fingerprints linked within the radius."""
    masks = band_masks(blocks or blocks_for(points.count(), radius), radius)
    cells = points.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("cell")
    ).select("fp", "rep", "cell.band", "cell.key")
    shared = cells.groupBy("band", "key").count().where("count > 1").select("band", "key", F.ceil(F.col("count") / tile_rows).cast("int").alias("subs"))
    own = F.pmod(F.xxhash64("fp", "band"), F.col("subs")).cast("int")
    pairs = (
        cells.join(shared, ["band", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    )

    def groups(batches):
        rest = None
        for batch in batches:
            own = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            own = own if rest is None else np.concatenate([rest, own])
            cut = np.flatnonzero((own[1:, :4] != own[:-1, :4]).any(axis=1)) + 1
            yield from _edges(own, [0, *cut.tolist()], radius)
            rest = own[cut[-1] if len(cut) else 0 :]
        if rest is not None:
            yield from _edges(rest, [0, len(rest)], radius)

    return pairs.repartition(shuffle_partitions(points.sparkSession), "band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", F.bit_count("fp")).mapInArrow(groups, "u long, v long").distinct()


def _edges(rows: np.ndarray, cuts: list[int], radius: int):
    found = [linked_stars(rows[a:b, 4].copy().view(np.uint64), rows[a:b, 5], radius) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], ["u", "v"])


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Returns doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    own = materialize(fingerprints(docs), "fingerprints")
    points = materialize(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    parts = connected_components(near_links(points, radius))
    named = points.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of docs that stay: of each group the document of the smallest id (of its repeated rows one); rows without an id stay."""
    return rows_that_stay(docs, near_duplicates(docs, radius).where("doc_id = component_id").select("doc_id").distinct())


def rows_that_stay(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each doc_id of kept, and the rows without an id.

    An id that stands in several rows keeps the one of the smallest text hash; equal texts are settled by the other columns.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    some = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("kept_id"), F.xxhash64("text").alias("h")).where("kept_id is not null")
    some = some.join(kept.select(F.col("doc_id").alias("kept_id")), "kept_id", "left_semi")
    first = W.partitionBy("kept_id").orderBy("h", *[F.col(f"row.{c}") for c in ("text", "lang", "source") if c in docs.columns])
    some = some.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
    return some.unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
