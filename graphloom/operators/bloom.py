"""A Bloom filter of a column, by built-in functions: what surely isn't among the values is dropped before a shuffle.

The filter is an array of 64-bit words that a scalar subquery makes: bits are set by or-ing partial words before and after the
shuffle, and one task puts the words in order. Its size follows the counted number of values at ``BITS`` each and ends at
``MOST_BITS`` (16 MB); with more values more rows pass for nothing, and what is done with them afterwards stays exact.

Edge cases: null passes never and is no value; repeated values set the same bits; without values nothing passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, MOST_BITS, HASHES = 12, 1 << 27, 4


def _places(value: Column, words: int) -> list[tuple[Column, Column]]:
    """(word, bit within it) for each hash of the value."""
    size = F.lit(64 * words).cast("long")
    first, second = F.pmod(F.xxhash64(value), size), F.pmod(F.xxhash64(F.lit(7), value), size)
    places = [F.pmod(first + i * second, size) for i in range(HASHES)]
    return [(F.shiftright(p, 6).cast("int"), (p % 64).cast("int")) for p in places]


def words_for(n: int) -> int:
    """Words of the filter for n values: a power of two."""
    return max(64, 1 << max(0, min(MOST_BITS, n * BITS) - 1).bit_length()) // 64


def filter_words(values: DataFrame, column: str, words: int) -> DataFrame:
    """One row with the filter's words in order (words: array<long>)."""
    one = F.lit(1).cast("long")
    bits = F.explode(F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", one, b).alias("bit")) for w, b in _places(F.col(column), words)]))
    own = values.where(F.col(column).isNotNull()).select(bits.alias("b")).groupBy("b.word").agg(F.bit_or("b.bit").alias("bits"))
    every = values.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = own.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("words"))


def may_be_in(values: DataFrame, column: str, value: Column) -> Column:
    """True where the value may be among those of the column; false only where it isn't."""
    words = words_for(values.count())
    stored = filter_words(values, column, words).scalar()
    passed = F.lit(True)
    for word, bit in _places(value, words):
        passed = passed & (F.call_function("getbit", F.get(stored, word), bit) == 1)
    return F.coalesce(passed, F.lit(False))
