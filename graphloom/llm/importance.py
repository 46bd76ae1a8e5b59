"""Importance resampling towards a target distribution, with an exact draw of the highest scores.

The words of all documents and of all target texts are counted in hashed buckets. A bucket's gain is the whole number of
thousandths of the logarithm of its smoothed target rate over its smoothed raw rate; a document's weight is the sum of the
gains of its features, looked up in a constant array. A Gumbel variable from a hash of the id is added, so that the highest
scores are a draw without replacement in proportion to ``exp(weight / 1000)``, the same in every run.

The draw doesn't sort the documents. Scores are whole numbers, so their histogram is exact: rows are counted by score, the
scores' counts are summed from the top (over at most ``BINS`` bins of equal width first, then within each bin), and the sum
before a score is the rank of its first row less one. The cutoff is the score in which the sum passes the wanted number.
Rows of lower scores are left alone; in each surviving score row_number by doc_id gives the place. A score that very
many rows share (more than ``HOT_ROWS``) is numbered in pieces of ``PIECE_IDS`` consecutive ids, whose counts are summed likewise, so
no task gets a hot score whole; of such scores there are few (at most ``MOST_HOT`` and one), and only they are broadcast.

Edge cases: null or empty text has no feature and weight 0; a null id draws by the empty string and comes after all others at
its score; of a repeated id each row draws alike and ties go to fewer features; a very long text is one row, counted and
weighed whole; no target text gives gains from the raw counts alone; too few rows to draw one give null ranks; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, id_and_text, materialize, read
from .hashed_grams import CRC_SQL, bucket_counts, runs, total_weight

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
BINS = 1 << 14
HOT_ROWS, MOST_HOT, PIECE_IDS = 1 << 16, 10_000, 1 << 16


def word_list(text: Column) -> Column:
    """lower() of pure ASCII lower-cases A-Z and nothing else, and is the faster of the two."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), 0)


def gains(raw: list[int], target: list[int]) -> list[int]:
    s, t, b = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log(float(y + 1) * float(s + b) / (float(x + 1) * float(t + b)))) for x, y in zip(raw, target)]


def gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score. The counts are taken here and now."""
    words = id_and_text(docs).select("doc_id", word_list(F.col("text")).alias("words"))
    wanted = target.select(word_list(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    (raw,), (aimed,) = (bucket_counts(df.select(runs(F.col("words"), order).alias("features")), buckets) for df in (words, wanted))
    featured = words.select("doc_id", F.size("words").cast("long").alias("n_words"), runs(F.col("words"), order).alias("features"))
    weighed = featured.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), total_weight(F.col("features"), gains(raw, aimed)).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def rank_offsets(rows: DataFrame, wanted: int) -> DataFrame:
    """rows (score: long) -> score, n, before (rows of higher scores), of all scores whose first row is among the wanted highest."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    width = max(1, -(-(high - low + 1) // BINS))
    counts = materialize(rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor((F.col("score") - low) / width)), "score-counts")
    above, bins = 0, []
    for b, n in sorted(counts.groupBy("bin").agg(F.sum("n")).collect(), reverse=True):  # at most BINS rows
        bins.append((b, above))
        above += n
        if above >= wanted:
            break
    starts = F.broadcast(rows.sparkSession.createDataFrame(bins, "bin long, above long"))
    within = F.sum("n").over(W.partitionBy("bin").orderBy(F.desc("score"))) - F.col("n")
    return counts.join(starts, "bin").select("score", "n", (F.col("above") + within).alias("before")).where(F.col("before") < wanted)


def drawn(rows: DataFrame, wanted: int) -> DataFrame:
    """rows (doc_id, n_features, weight, score), a stored table -> its rows of surviving scores with rank, null beyond wanted."""
    offsets = materialize(rank_offsets(rows, wanted), "rank-offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    hot = offsets.where(F.col("n") > max(HOT_ROWS, wanted // MOST_HOT)).select("score", F.lit(True).alias("hot"))
    piece = F.when(F.col("hot"), F.coalesce(F.floor(F.col("doc_id") / PIECE_IDS), F.lit(2**62))).otherwise(F.lit(0))
    near = rows.where(F.col("score") >= cutoff).join(F.broadcast(hot), "score", "left").withColumn("piece", piece).drop("hot")
    sizes = near.groupBy("score", "piece").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(W.partitionBy("score").orderBy("piece")) - F.col("m")
    firsts = sizes.join(offsets, "score").select("score", "piece", (F.col("before") + earlier).alias("first"))
    place = F.row_number().over(W.partitionBy("score", "piece").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = near.join(firsts, ["score", "piece"]).withColumn("rank", F.col("first") + place)
    return ranked.select(*rows.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **features) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it wasn't drawn."""
    rows = materialize(scored(docs, target, **features), "importance-scores")
    able = rows.where(F.col("n_words") >= min_words)
    wanted = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*columns, none)
    surviving = materialize(drawn(able, wanted), "importance-draw")
    cutoff = surviving.agg(F.min("score")).first()[0]
    rest = rows.where((F.col("n_words") < min_words) | (F.col("score") < cutoff))
    return surviving.select(*columns, "rank").unionByName(rest.select(*columns, none))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), aims AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), raw_features AS (SELECT doc_id, unnest(words) AS feature FROM docs), aim_features AS (SELECT unnest(words) AS feature FROM aims),
distinct_features AS (SELECT feature FROM raw_features UNION SELECT feature FROM aim_features),
{CRC_SQL},
raw_counts AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS s FROM raw_features JOIN feature_crc USING (feature) GROUP BY 1),
aim_counts AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS t FROM aim_features JOIN feature_crc USING (feature) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw_counts) AS all_s, (SELECT coalesce(sum(t), 0) FROM aim_counts) AS all_t),
bucket_gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM raw_counts LEFT JOIN aim_counts USING (bucket), totals
), weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM raw_features JOIN feature_crc USING (feature) JOIN bucket_gains ON bucket = crc % {BUCKETS} GROUP BY doc_id
), scores AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {PERCENT} // 100 AS wanted FROM scores WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
