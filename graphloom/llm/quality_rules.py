"""Quality rules: base rules of a text's form, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed buckets of words and word pairs are counted in one pass: one of the trusted target's documents, one
of all documents. Both are smoothed by ``PRIOR`` occurrences a bucket on the target's scale, so that buckets of little evidence
weigh little: the ratio of a bucket is ``(t + PRIOR) / (s * T / S + PRIOR)``, t of T occurrences being the target's and s of S all.
A document's log ratio is the sum of its features' logarithms (in whole thousandths, so that sums are the same in any order)
over their number. Each document that passes the base rules is kept if it is ``LEAST`` or more: no row is drawn or sampled.

The trusted target of the query is every document labelled good that isn't held out. Base rules and ratio need nothing but the
row itself and a constant array, so only the bucket counts and the marks of the trusted ids are ever shuffled. Windows of
three words are compared by sorting them within the row, in n log n steps.

Edge cases: null or empty text has no word and fails; a document with the smallest number of words has features; a null id is
never trusted; of a repeated id all rows are trusted or none, and each has its row; without a trusted document all ratios are 0; a very
long text is one row, counted whole; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, held_out, id_and_text, materialize, read
from .hashed_grams import CRC_SQL, bucket_counts, runs, total_weight

WORD, SYMBOLS, WINDOW = r"[^\x20\x09-\x0D]+", "#*$%&|<>", 3
MIN_WORDS, MOST_REPEATED = 50, 50
ORDER, BUCKETS, PRIOR, LEAST = 2, 1 << 16, 5, -120
OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_features", "weight", "log_ratio", "base_failed", "kept")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(WHITE))) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def with_base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, words and the base counts."""
    rows = docs.select("*", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    number = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    hashes = windows = F.slice("words", 1, number)
    for k in range(2, WINDOW + 1):
        hashes = F.zip_with(hashes, F.slice("words", k, number), lambda run, w: F.xxhash64(run, w))
        windows = F.zip_with(windows, F.slice("words", k, number), lambda run, w: F.concat_ws(" ", run, w))
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("hash"), w.alias("window"), i.alias("at"))))
    # where all hashes differ, as in most texts, all windows do, and none is sorted
    rows = rows.select("doc_id", "text", "words", F.when(F.size(F.array_distinct(hashes)) < number, placed).alias("windows"))
    rest = F.slice("windows", 2, F.size("windows"))
    neighbours = F.zip_with("windows", rest, lambda a, b: F.when(a.window == b.window, F.array(*[w["at"] + k for w in (a, b) for k in range(WINDOW)])))
    covered = F.flatten(F.filter(neighbours, lambda places: places.isNotNull()))
    counts = {
        "n_words": F.size("words"), "word_chars": F.char_length(F.array_join("words", "")), "n_symbols": F.regexp_count("text", F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": repeated_lines(F.col("text")), "n_repeat_words": F.when(F.col("windows").isNull(), 0).otherwise(F.size(F.array_distinct(covered))),
    }
    return rows.select("doc_id", "words", *[c.cast("long").alias(name) for name, c in counts.items()])


def log_ratios(raw: list[int], trusted: list[int], prior: int = PRIOR) -> list[int]:
    s, t = float(sum(raw)), float(sum(trusted))
    return [math.floor(1000 * math.log((y + prior) / (x * t / s + prior))) if s else 0 for x, y in zip(raw, trusted)]


def bucket_ratios(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """The thousandths of the log ratio of each bucket, from all docs and from those whose ids are trusted."""
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).where("doc_id is not null").distinct()
    # joined by shuffling whatever the sizes: the ids grow with the corpus
    rows = id_and_text(docs).join(ids.hint("shuffle_hash"), "doc_id", "left").select("trusted", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    return log_ratios(*bucket_counts(rows.select("trusted", runs(F.col("words"), order).alias("features")), buckets, F.coalesce("trusted", F.lit(False))))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text), trusted_ids (doc_id) -> OUT, a row for each of docs.

    The rows are computed once, here and now, and stored: a filter on them would else move down and compute the arrays again.
    """
    ratios = bucket_ratios(docs, trusted_ids, order)
    counted = with_base_counts(id_and_text(docs)).select("*", runs(F.col("words"), order).alias("features"))
    weighed = counted.select("*", F.size("features").cast("long").alias("n_features"), total_weight(F.col("features"), ratios).alias("weight"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    ratio = F.when(F.col("n_features") > 0, F.col("weight") / F.col("n_features") / 1000).otherwise(0.0)
    judged = weighed.select("*", failed.alias("base_failed"), ratio.alias("log_ratio"))
    kept = ~F.col("base_failed") & (F.col("weight") >= least * F.col("n_features"))
    return materialize(judged.select("*", kept.alias("kept")).select(*OUT), "quality-rules")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return quality_rules(read(spark, sf_dir, "documents"), labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))))


#: held_out in SQL needs a crc32 of the id, which is that of its text as a feature.
OP13_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM docs),
features AS (
  SELECT doc_id, word AS feature FROM places
  UNION ALL SELECT doc_id, word || ' ' || next FROM (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM places) WHERE next IS NOT NULL
), distinct_features AS (SELECT feature FROM features UNION SELECT CAST(doc_id AS VARCHAR) FROM labels),
{CRC_SQL},
trusted AS (SELECT DISTINCT doc_id FROM labels JOIN feature_crc ON feature = CAST(doc_id AS VARCHAR) WHERE quality = 1 AND crc % 5 <> 0),
counts AS (
  SELECT crc % {BUCKETS} AS bucket, count(*) AS s, count(trusted.doc_id) AS t FROM features JOIN feature_crc USING (feature) LEFT JOIN trusted ON features.doc_id = trusted.doc_id GROUP BY 1
), ratios AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + {PRIOR} AS DOUBLE) / (CAST(s AS DOUBLE) * CAST((SELECT sum(t) FROM counts) AS DOUBLE) / CAST((SELECT sum(s) FROM counts) AS DOUBLE) + {PRIOR}))) AS BIGINT) AS ratio FROM counts
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(ratio) AS BIGINT) AS weight FROM features JOIN feature_crc USING (feature) JOIN ratios ON bucket = crc % {BUCKETS} GROUP BY doc_id
), windows AS (
  SELECT doc_id, pos, word || ' ' || b || ' ' || c AS w FROM (SELECT doc_id, pos, word, lead(word) OVER own AS b, lead(word, 2) OVER own AS c FROM places WINDOW own AS (PARTITION BY doc_id ORDER BY pos)) WHERE c IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS m FROM windows), range(3) t(k) WHERE m > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN weights USING (doc_id)
)
SELECT *, CASE WHEN n_features > 0 THEN CAST(weight AS DOUBLE) / n_features / 1000 ELSE 0 END AS log_ratio, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND weight >= {LEAST} * n_features AS kept
FROM base
"""
