"""Runs of words hashed to buckets: the features of importance resampling and of the quality rules.

A feature is a run of 1 to n consecutive words joined by one space; its bucket is the unsigned crc32 of its UTF-8 bytes
modulo the number of buckets. Counts over all rows are summed in the tasks before they are shuffled, so what is shuffled
and what reaches the driver is one number for each bucket. Weights go back into the plan as a constant array, and a text
is scored within its row: nothing is joined and a long text moves nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(words: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words of an array, repeats included.

    No lambda looks into the array: where the optimizer writes an expression in the place of its column, as filters that
    move down do, a lambda would compute the array anew for each element.
    """
    out = longest = words
    for length in range(2, n + 1):
        number = F.greatest(F.size(words) - (length - 1), F.lit(0))
        longest = F.zip_with(F.slice(longest, 1, number), F.slice(words, length, number), lambda run, w: F.concat_ws(" ", run, w))
        out = F.concat(out, longest)
    return out


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(features: DataFrame, buckets: int, *marks: Column) -> tuple[list[int], ...]:
    """features (features: array<string>) -> occurrences in each bucket; for each further boolean, those of the rows where it holds."""
    names = [f"mark_{i}" for i in range(len(marks))]
    # explode would infer a filter on the array's size, and compute the array twice
    each = features.select(*[m.alias(name) for m, name in zip(marks, names)], F.explode_outer("features").alias("feature")).withColumn("bucket", bucket(F.col("feature"), buckets))
    out = tuple([0] * buckets for _ in range(1 + len(marks)))
    for r in each.where("feature is not null").groupBy("bucket").agg(F.count("*"), *[F.count_if(F.col(name)) for name in names]).collect():  # at most a row for each bucket
        for counts, v in zip(out, r[1:]):
            counts[r[0]] = v
    return out


def total_weight(features: Column, weights: list[int]) -> Column:
    """The sum of the whole-number weights of a text's features."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # becomes one constant
    return F.aggregate(features, F.lit(0).cast("long"), lambda total, f: total + F.get(table, bucket(f, len(weights)).cast("int")))


#: DuckDB SQL: CTEs crc_table(crc) and, from a table distinct_features(feature), feature_crc(feature, crc).
CRC_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), feature_bytes AS (
  SELECT feature, list_transform(range(0, octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM distinct_features
), feature_crc AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM feature_bytes, crc_table
)"""
