"""Token-ID output: raw shard files of ids, and a minimal perfect hash index from document keys to shard offsets.

Format. Documents stand in ascending order of id (null first; rows of one id by text). A shard is one file:

* header: magic, bytes per id, ordinal of the shard, number of documents, number of ids;
* directory: per document its id, whether it has one, its occurrence among rows of the same id, its number of ids;
* payload: the ids, one after another, little endian;
* one closing newline, which the writer adds.

Spark's text writer writes the bytes, so the files can be in any store that Spark writes to, and its committer makes a
lost task harmless. Files are read with the ``binaryFile`` source. A shard holds about ``shard_ids`` ids, or one
document if that is longer.

Index. Keys (id, occurrence) are dealt to index parts by hash; each part is a minimal perfect hash (compress, hash and
displace; sub-buckets of one key hold their slot directly) over its keys, with arrays of fingerprints and of locations
in slot order. A lookup computes one slot, compares the 32-bit fingerprint and reads one location: constant time.

Edge cases: null text is an empty document (only the end id); null ids and repeated ids are documents of their own;
an empty table writes no shard and gives no row; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .chunk_encoder import CACHED_CHUNKS, encoder
from .common import fresh_path, id_and_text, materialize, shuffle_partitions

MAGIC = b"TOKSHRD1"
HEADER = "<8sIQQQ"
HEADER_SIZE = struct.calcsize(HEADER)
DIRECTORY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("occurrence", "<u4"), ("n", "<u8")])
LOCATION = np.dtype([("shard", "<i8"), ("offset", "<u8"), ("n", "<u8")])
BLOCKS = 1 << 24  # of shards within one partition
KEYS_PER_PART = 50_000
RANGE_CHARS = 64


def pieces(batches, most_bytes: int = 1 << 20):
    """Keys and texts of Arrow batches, as Python lists of about most_bytes of text, one text at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            own = batch.slice(start, end - start)
            yield own.column(0).to_pylist(), own.column(1).to_pylist()
            start = end


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 4_000_000, partitions: int | None = None, cached: int = CACHED_CHUNKS) -> None:
    """Encodes every whole text, appends end_id and writes the shards below path.

    The text is dealt out before it is encoded, by ranges of the id and, so that rows without an id or of one id part
    too, of the text's first ``RANGE_CHARS`` characters. cached bounds the encoder's memory in a Python worker.
    """
    spark = docs.sparkSession

    def shards(batches):
        enc, part, block, last, seen = encoder(tokenizer, cached), TaskContext.get().partitionId(), 0, None, 0
        end, rows, ids, size = np.array([end_id], dtype=enc.dtype).tobytes(), [], [], 0

        def shard():
            head = struct.pack(HEADER, MAGIC, enc.dtype.itemsize, part * BLOCKS + block, len(rows), size)
            data = b"".join([head, np.array(rows, dtype=DIRECTORY).tobytes(), *ids])
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

        for keys, texts in pieces(batches):
            for key, own in zip(keys, enc.encode(texts)):
                n = len(own) // enc.dtype.itemsize + 1
                if rows and size + n > shard_ids:
                    yield shard()
                    block, rows, ids, size = block + 1, [], [], 0
                seen = seen + 1 if (key,) == last else 0
                last = (key,)
                rows.append((key or 0, key is not None, seen, n))
                ids += (own, end)
                size += n
        if rows:
            yield shard()

    order = F.col("doc_id").asc_nulls_first()
    (
        id_and_text(docs)
        .repartitionByRange(partitions or shuffle_partitions(spark), order, F.substring("text", 1, RANGE_CHARS))
        .sortWithinPartitions(order, "text")
        .mapInArrow(shards, "shard binary")
        .select(F.col("shard").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .text(path)
    )


def _parse(data: bytes):
    magic, width, shard, n_docs, n_ids = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEADER_SIZE + n_docs * DIRECTORY.itemsize
    if len(data) != at + n_ids * width + 1:
        raise ValueError(f"shard {shard} is cut off")
    return shard, np.frombuffer(data, DIRECTORY, n_docs, HEADER_SIZE), np.frombuffer(data, f"<u{width}", n_ids, at)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the shard files: key, shard, offset in it, number of ids, crc32 of its ids as 32-bit integers."""

    def records(batches):
        for batch in batches:
            for data in batch.column("content"):
                shard, rows, ids = _parse(data.as_buffer())
                ends = np.cumsum(rows["n"].astype(np.int64))
                starts = ends - rows["n"].astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["doc_id"].astype(np.int64), mask=rows["has_id"] == 0),
                        pa.array(rows["occurrence"].astype(np.int64)),
                        pa.array(np.full(len(rows), shard, np.int64)),
                        pa.array(starts),
                        pa.array(rows["n"].astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "occurrence", "shard", "offset", "n_tokens", "ids_crc32"],
                )

    return shard_files(spark, path).mapInArrow(records, "doc_id long, occurrence long, shard long, offset long, n_tokens long, ids_crc32 long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key_hash(doc_id: pd.Series, occurrence: pd.Series) -> np.ndarray:
    ids, none = doc_id.fillna(0).astype(np.int64).to_numpy().astype(np.uint64), doc_id.isna().to_numpy()
    return _mix(_mix(ids + np.uint64(0x9E3779B97F4A7C15)) + (occurrence.to_numpy().astype(np.uint64) << np.uint64(1)) + none.astype(np.uint64))


def _slots(h: np.ndarray, seed, n: int) -> np.ndarray:
    return _mix(h + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ np.uint64(0xD6E8FEB86659FD93)).astype("<u4")


def minimal_perfect_hash(h: np.ndarray) -> np.ndarray:
    """Seeds of the sub-buckets (four keys on average) such that each of the distinct hashes h gets a slot of its own in 0..len(h)-1.

    A seed s >= 0 displaces by hashing; -1 - slot names the slot of a sub-bucket's only key.
    """
    n = len(h)
    subs = max(1, -(-n // 4))
    bucket = ((h >> np.uint64(33)) % np.uint64(subs)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=subs)
    starts = np.cumsum(sizes) - sizes
    seeds, taken = np.zeros(subs, "<i8"), np.zeros(n, bool)
    largest_first = np.argsort(-sizes, kind="stable")
    for b in largest_first[: int((sizes > 1).sum())]:
        keys = h[order[starts[b] : starts[b] + sizes[b]]]
        first = 1
        while True:  # 64 seeds at a time
            slots = np.sort(_slots(keys[None], np.arange(first, first + 64)[:, None], n).astype(np.int64), axis=1)
            good = np.flatnonzero(~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
            if len(good):
                break
            first += 64
            if first > 10_000_000:
                raise ValueError("two keys with one hash")
        taken[slots[good[0]]], seeds[b] = True, first + good[0]
    single = largest_first[int((sizes > 1).sum()) : int((sizes > 0).sum())]
    seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return seeds


def find_slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    own = seeds[((h >> np.uint64(33)) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(own < 0, -1 - own, _slots(h, np.maximum(own, 0), n).astype(np.int64))


def build_index(records: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per index part: n, seeds, fingerprints and locations in slot order."""
    parts = parts or max(1, -(-records.count() // KEYS_PER_PART))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _key_hash(pdf["doc_id"], pdf["occurrence"])
        seeds = minimal_perfect_hash(h)
        slots = find_slots(h, seeds, len(h))
        prints, places = np.zeros(len(h), "<u4"), np.zeros(len(h), LOCATION)
        prints[slots] = _fingerprints(h)
        for field, column in (("shard", "shard"), ("offset", "offset"), ("n", "n_tokens")):
            places[field][slots] = pdf[column].to_numpy()
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [len(h)], "seeds": [seeds.tobytes()], "fingerprints": [prints.tobytes()], "locations": [places.tobytes()]})

    return _with_part(records, parts).groupBy("part").applyInPandas(build, "part long, n long, seeds binary, fingerprints binary, locations binary").withColumn("parts", F.lit(parts))


def _with_part(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(parts)).cast("long"))


def look_up(index: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """The location of each key (doc_id, occurrence); keys that the index doesn't hold give no row."""

    def find(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(keys):
            return pd.DataFrame({c: [] for c in ("doc_id", "occurrence", "shard", "offset", "n_tokens")})
        n, places = int(own["n"].iloc[0]), np.frombuffer(own["locations"].iloc[0], LOCATION)
        h = _key_hash(keys["doc_id"], keys["occurrence"])
        slots = find_slots(h, np.frombuffer(own["seeds"].iloc[0], "<i8"), n)
        hit = np.frombuffer(own["fingerprints"].iloc[0], "<u4")[slots] == _fingerprints(h)
        at, keys = places[slots[hit]], keys[hit]
        return pd.DataFrame({"doc_id": keys["doc_id"], "occurrence": keys["occurrence"], "shard": at["shard"], "offset": at["offset"].astype(np.int64), "n_tokens": at["n"].astype(np.int64)})

    return _with_part(keys, parts).groupBy("part").cogroup(index.groupBy("part")).applyInPandas(find, "doc_id long, occurrence long, shard long, offset long, n_tokens long")


def fetch_ids(spark: SparkSession, path: str, located: DataFrame) -> DataFrame:
    """(doc_id, occurrence, ids) of located keys, cut from the raw payloads by shard, offset and length."""

    def cut(wanted: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(files) or not len(wanted):
            return pd.DataFrame({"doc_id": [], "occurrence": [], "ids": []})
        ids = _parse(files["content"].iloc[0])[2]
        return pd.DataFrame({"doc_id": wanted["doc_id"], "occurrence": wanted["occurrence"], "ids": [ids[a : a + n].astype(np.int64).tolist() for a, n in zip(wanted["offset"], wanted["n_tokens"])]})

    def numbered(batches):
        for batch in batches:
            data = batch.column("content")
            yield pa.RecordBatch.from_arrays([pa.array([_parse(d.as_py())[0] for d in data], pa.int64()), data], ["shard", "content"])

    files = shard_files(spark, path).mapInArrow(numbered, "shard long, content binary").join(located.select("shard").distinct(), "shard", "left_semi")
    return located.groupBy("shard").cogroup(files.groupBy("shard")).applyInPandas(cut, "doc_id long, occurrence long, ids array<long>")


def ids_before(records: DataFrame) -> DataFrame:
    """shard, before: the ids of all earlier shards. Sums by the partition that wrote a shard come first, so one task orders those only."""
    part = F.shiftright("shard", BLOCKS.bit_length() - 1).alias("writer")
    shards = records.groupBy(part, "shard").agg(F.sum("n_tokens").alias("ids"))
    writers = shards.groupBy("writer").agg(F.sum("ids").alias("all_ids"))
    offsets = writers.select("writer", (F.sum("all_ids").over(W.orderBy("writer")) - F.col("all_ids")).alias("first"))
    within = F.sum("ids").over(W.partitionBy("writer").orderBy("shard")) - F.col("ids")
    return shards.withColumn("within", within).join(offsets, "writer").select("shard", (F.col("first") + F.col("within")).alias("before"))


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, cached: int = CACHED_CHUNKS) -> DataFrame:
    """Writes shards and index, then finds every document through the index.

    The index gives a key's shard, offset and length; what the files hold there gives the crc32 of its ids. A key that
    the index misplaces, or that takes another's fingerprint, meets no payload or a second one: then the rows aren't those
    of the documents, and it raises. Returns doc_id, occurrence, start (ids of all documents before it), shard, offset, n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_shards(docs, path + "/shards", tokenizer, end_id, cached=cached)
    records = materialize(read_records(spark, path + "/shards"), "token-records")
    n = records.count()
    parts = max(1, -(-n // KEYS_PER_PART))
    build_index(records, parts).write.parquet(path + "/index")
    index = spark.read.parquet(path + "/index")
    payload = records.select("shard", "offset", "n_tokens", "ids_crc32", F.struct("doc_id", "occurrence").alias("own"))
    found = look_up(index, records.select("doc_id", "occurrence"), parts).join(payload, ["shard", "offset", "n_tokens"])
    placed = found.join(ids_before(records), "shard").select("doc_id", "occurrence", (F.col("before") + F.col("offset")).alias("start"), "shard", "offset", "n_tokens", "ids_crc32", F.col("own").eqNullSafe(F.struct("doc_id", "occurrence")).alias("right"))
    out = materialize(placed, "token-places")
    right, every = out.where("right").count(), out.count()
    if right != n or every != n:
        raise ValueError(f"the index finds {right} of {n} documents, and {every - right} wrong ones")
    return out.drop("right")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")
