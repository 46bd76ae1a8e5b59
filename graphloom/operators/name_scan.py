"""Which of many names a text holds: one pass of an automaton over the texts, for any number of names.

Names are dealt to blocks by hash so that a block's names take about ``BLOCK_BYTES``, which are counted first. A block goes to the
tasks as a broadcast list, a worker builds an Aho-Corasick automaton of it once, and texts pass through it in Arrow batches. Where the names
fill several blocks, the texts pass once for each, and what a pass finds is written before the next, so neither driver
nor worker ever holds more than one block. Up to ``FEW`` names are tested by built-in functions instead: same rows, no Python.

Edge cases: texts and names are compared with case folded; null texts hold nothing; null and empty names are held by no text;
names that are parts of one another are each found; no names, no rows. Keys may be null and may repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..storage import materialize

FEW = 8
BLOCK_BYTES = 4 << 20
_BUILT: dict[str, object] = {}  # of this worker: the automaton of the last block


def _automaton(number: str, wanted: list[str]):
    import ahocorasick

    if number not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for w in wanted:
            built.add_word(w, w)
        built.make_automaton()
        _BUILT[number] = built
    return _BUILT[number]


def _scan(block):
    """A function of a column of folded texts: the sorted distinct names of the block in each."""

    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(block.value[0], block.value[1])
        for texts in batches:
            yield pd.Series([[] if t is None else sorted({name for _, name in automaton.iter(t)}) for t in texts], dtype=object)

    return F.pandas_udf(held, "array<string>")


def names_held(rows: DataFrame, text: Column, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns of rows and name: a row for each row and each wanted name (name, in any case) that its text holds, folded."""
    spark = rows.sparkSession
    own = wanted.select(names.fold_ci("name").alias("name")).where("name is not null and name <> ''").distinct()
    few = [r.name for r in own.limit(FEW + 1).collect()]
    said = rows.select(*keys, names.fold_ci(text).alias("_said"))
    if len(few) <= FEW:
        tests = [F.when(F.col("_said").contains(n), F.lit(n)) for n in sorted(few)]
        found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
        return said.select(*keys, F.explode(found).alias("name"))
    own = materialize(own, "names")
    blocks = -(-own.agg(F.sum(F.octet_length("name") + 64)).first()[0] // BLOCK_BYTES)
    out = None
    for i in range(blocks):
        part = sorted(r.name for r in own.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i).collect())
        if not part:
            continue
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, part))
        found = said.select(*keys, F.explode(_scan(block)(F.col("_said"))).alias("name"))
        if blocks > 1:
            found = materialize(found, "names-held")
            block.destroy()
        out = found if out is None else out.unionByName(found)
    return out
