"""Comparisons that ignore case."""

from pyspark.sql import functions as F

from graphloom.functions import names


def test_fold_keeps_one_character_for_one(spark):
    rows = spark.createDataFrame([(c,) for c in "ßẞﬁİıſaÉéσςµ"] + [("straße",), ("Plain",), (None,)], "t string")
    got = {r.t: r.f for r in rows.select("t", names.fold_ci("t").alias("f")).collect()}
    assert got == {"ß": "ß", "ẞ": "ẞ", "ﬁ": "ﬁ", "İ": "İ", "ı": "ı", "ſ": "ſ", "a": "A", "É": "É", "é": "É", "σ": "Σ", "ς": "Σ", "µ": "Μ", "straße": "STRAßE", "Plain": "PLAIN", None: None}
    assert all(names.fold_text(t) == f for t, f in got.items() if t)
    assert rows.where(names.equals_ci(F.col("t"), F.lit("STRASSE"))).count() == 0
    assert rows.where(names.contains_ci(F.col("t"), F.lit("LAI"))).count() == 1
