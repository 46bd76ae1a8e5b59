"""Near copies by word shingles: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Words are those of the SimHash module; a document of fewer than five words has its whole line as its one shingle.
Documents of equal shingle sets become one node with the smallest id. SimHash comes first: fingerprints of the five-word
shingles within ``RADIUS`` bits, linked by that module's tiles, are candidates, whether or not a band below has them too, and they settle most groups. At similarity 0.8
fingerprints differ by some 9 bits, which no tiling of buckets reaches at scale, so further candidates share one of ``BANDS`` MinHash bands
of ``ROWS`` values (a pair of similarity 0.8 is missed with probability 0.0007, one of 0.9 with less than 1e-7), and
only pairs whose exact similarity passes are linked; the links are joined by connected components.

To test no group pair by pair, each round compares the members of a bucket with a few leaders of it: the member that
shares most with others over all its buckets (of edited copies, the text that they were made from), and others picked by
hashes that differ from round to round. It goes on with buckets that still hold more than one component. The members of what is left
are compared all with all in tiles of bounded size, from which only spanning links come out, so every candidate pair is
either tested or joined by other links, and no pair is a row of a table but those with leaders. What the rounds write on the way is deleted when the stage's ids are known. Hash tables and buckets are dealt by Spark; no document's shingles leave its row unless it has a candidate.

Edge cases: null text is empty; texts without words are copies of each other; rows without an id take no part; an id
of several texts is one node, near whatever one of its texts is near; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, id_and_text, in_slices, materialize, scratch
from .components import connected_components
from .simhash import fingerprints, near_links, rows_that_stay

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST, OF = 4, 5
BANDS, ROWS, LEADER_ROUNDS, LEADERS = 24, 6, 4, 5
RADIUS = 4
TILE, COLUMNS = 256, 4096
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    return np.unique(np.fromiter([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 10):
        mixed = hashes[None, i : i + (1 << 10)] * FACTORS[:, None] + OFFSETS[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (column >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, whole (a 128-bit hash of the shingle set), n (its size), keys (one of each band)."""

    def apply(batches):
        from xxhash import xxh3_128_digest

        for batch in in_slices(batches):
            ids, whole, n, keys = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                whole.append(xxh3_128_digest(own.tobytes()))
                n.append(len(own))
                keys.append(bands(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(whole, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "whole", "n", "keys"])

    return id_and_text(docs.where("doc_id is not null")).mapInArrow(apply, "doc_id long, whole binary, n int, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, hashes: the distinct shingle sets of each id."""

    def apply(batches):
        for batch in in_slices(batches):
            sets = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return id_and_text(docs).mapInArrow(apply, "doc_id long, hashes array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that have shingle sets of the least similarity."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"{c}_set")) for c in ("u", "v"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    nu, nv = F.size("u_set"), F.size("v_set")
    fits = pairs.join(right, "v").join(left, "u").where((F.least(nu, nv) * OF >= F.greatest(nu, nv) * LEAST) & (both * OF >= (nu + nv - both) * LEAST))
    return fits.select("u", "v").distinct()


def simhash_pairs(docs: DataFrame, same: DataFrame) -> DataFrame:
    """(u, v), u < v: spanning pairs of the sets of documents whose fingerprints lie within the radius; same: copies (v) to leave out."""
    own = materialize(fingerprints(docs.where("doc_id is not null"), SHINGLE).join(same.select(F.col("v").alias("doc_id")), "doc_id", "left_anti"), "fingerprints")
    points = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    equal = own.join(points, "fp").where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    near = near_links(points, RADIUS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return equal.unionByName(near).distinct()


def linked_sets(reps: np.ndarray, sets: list) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, smallest id) of the ids whose shingle sets have the least similarity, all sets against all."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    _, count = np.unique(flat[order], return_counts=True)
    number = np.repeat(np.where(count > 1, np.cumsum(count > 1) - 1, -1), count)  # of the hashes that two sets or more share, in order
    owner, number = owner[number >= 0], number[number >= 0]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(number, [a, a + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[low:high], number[low:high] - a] = 1
        both += has @ has.T
    x, y = np.nonzero(np.triu(both * OF >= (sizes[:, None] + sizes[None] - both) * LEAST, 1))
    ids, place = np.unique(reps, return_inverse=True)  # an id of several texts has a set for each
    x, y, root = place[x], place[y], np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, x, before[y])
        np.minimum.at(root, y, before[x])
        if (root == before).all():
            break
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def tile_links(live: DataFrame, split: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v), u < v: spanning links of all similar members of the split buckets (bucket, n).

    A bucket of more than TILE members is dealt by hash over sub-buckets, and each pair of these is a task group of its own, so
    that no group holds more than some 2 TILE sets, and no pair of members is a row.
    """

    def group(pdf):
        u, v = linked_sets(pdf["rep"].to_numpy(), list(pdf["hashes"]))
        return pd.DataFrame({"u": v, "v": u})

    own = live.join(split, "bucket").withColumn("subs", F.ceil(F.col("n") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.col("subs")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep")
    return dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep").groupBy("bucket", "lo", "hi").applyInPandas(group, "u long, v long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """Returns doc_id, component_id (smallest doc_id reachable over near copies, itself included), rows without an id left out."""
    own = materialize(sketches(docs), "sketches")
    points = materialize(own.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "points")
    # ids of one text stand for their group's smallest; further texts of an id are links of their own
    same = own.join(points.select("whole", "rep"), "whole").where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    links = materialize(same.distinct(), "copies")
    cells = points.select("rep", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "rep")
    shared = cells.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("size")).where("a <> b").select("bucket", "size")
    members = materialize(cells.join(shared, "bucket").distinct(), "members")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = materialize(members.select("bucket", "rep").join(weights, "rep"), "weighed-members")
    tested = materialize(simhash_pairs(docs, same), "simhash-pairs")
    asked = members.select(F.col("rep").alias("doc_id")).union(tested.select(F.explode(F.array("u", "v")))).distinct()
    some = materialize(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(asked, "doc_id", "left_semi").select("doc_id", "text"), "asked")
    sets = materialize(shingle_sets(some).distinct(), "shingle-sets")
    links = links.unionByName(materialize(similar(tested, sets), "found"))
    for at in range(LEADER_ROUNDS + 1):
        parts = materialize(connected_components(links), "parts")
        live = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "weight", F.coalesce("component", "rep").alias("part"))
        picks = [F.min(F.struct(F.xxhash64("rep", F.lit(at * LEADERS + i)).alias("h"), "rep", "part")) for i in range(LEADERS - 1)]
        picks.append(F.max(F.struct(F.col("weight").alias("h"), "rep", "part")))
        leads = F.array_distinct(F.array(*[F.struct(x["rep"].alias("rep"), x["part"].alias("part")) for x in picks])).alias("lead")
        split = live.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n"), leads).where("a <> b")
        if at == LEADER_ROUNDS:
            links = links.unionByName(materialize(tile_links(live, split.select("bucket", "n"), sets), "tile-links"))
            break
        leaders = split.select("bucket", F.explode("lead").alias("lead")).select("bucket", F.col("lead.rep").alias("other"), F.col("lead.part").alias("other_part"))
        pairs = live.join(leaders, "bucket").where("part <> other_part").select(F.least("rep", "other").alias("u"), F.greatest("rep", "other").alias("v")).distinct()
        pairs = materialize(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = links.unionByName(materialize(similar(pairs, sets), "found"))
    parts = connected_components(links)
    return own.select("doc_id").distinct().join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the document of the smallest id (of its repeated rows one); rows without an id stay."""
    with scratch(docs.sparkSession) as keep:
        kept = keep(near_copies(docs).where("doc_id = component_id").select("doc_id"), "kept-ids")
    return rows_that_stay(docs, kept)
