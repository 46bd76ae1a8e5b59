"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells (source, language, topic) with their tokens. The cells' token weights are raked: each
round scales them to the source, then the language, then the topic marginal, until no marginal is off by more than
``TOLERANCE``. A cell's weight over its tokens is its rate; a document is kept with probability ``c * rate``, at most 1,
decided by a hash of its id, so that kept tokens follow the targets in expectation and the same document is always
decided alike. c is such that the expected tokens make up ``keep`` of all (or the given token budget): a rare cell of a large
rate is kept whole and moves nothing else. Where cells are kept whole and still fall short, ``residuals`` tells by how much.

Default targets temper the observed shares of sources and languages (``share ** temper``, rescaled), and keep topics. The
topic is any column expression; the default is a rough one by the form of the text.
A hot source is one row per task after partial sums. Up to ``ONE_TASK_CELLS`` cells are raked in one task, which needs no
shuffle; more of them (a source for each web host) by sums and joins over all tasks, with the same results.

Edge cases: null categories are the category "(none)"; null or empty text has 0 tokens and probability 1 of its own
(it weighs nothing); a null id draws by the text; repeated ids draw alike; an empty table gives no
row; a marginal without a target row for a category gives that category weight 0; a very long text is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TEMPER, KEEP = 8, 0.9, 0.9
TOLERANCE, MOST_STEPS = 1e-4, 50
ONE_TASK_CELLS = 200_000
NONE = "(none)"


def form(text: Column) -> Column:
    """A rough topic by the form of the text."""
    return F.when(text.contains(" | "), "table").when(F.lower(text).contains("licen"), "legal").when(text.contains("@"), "contact").otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def categories(topic: Column | None = None) -> dict[str, Column]:
    return {
        "source": F.coalesce("source", F.lit(NONE)),
        "lang": F.coalesce("lang", F.lit(NONE)),
        "topic": F.coalesce(form(F.coalesce(F.col("text"), F.lit(""))) if topic is None else topic, F.lit(NONE)),
    }


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, draw (a number in [0, 1) fixed by the id)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *[c.alias(d) for d, c in categories(topic).items()], n_tokens(text).alias("tokens"), draw(F.col("doc_id"), text).alias("draw"))


def cell_tokens(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def _by_dimension(cells: DataFrame, amount: str) -> DataFrame:
    """dimension, category and the sum of amount."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS])).alias("d")
    return cells.select(each, amount).groupBy("d.dimension", "d.category").agg(F.sum(amount).cast("double").alias(amount))


def tempered_targets(cells: DataFrame, temper: float = TEMPER) -> DataFrame:
    """(dimension, category, share): target marginals, the observed shares tempered for source and language."""
    power = F.when(F.col("dimension") == "topic", 1.0).otherwise(temper)
    raised = _by_dimension(cells, "tokens").withColumn("raised", F.pow(F.col("tokens") / F.sum("tokens").over(W.partitionBy("dimension")), power))
    return raised.select("dimension", "category", (F.col("raised") / F.sum("raised").over(W.partitionBy("dimension"))).alias("share"))


def residuals(cells: DataFrame, targets: DataFrame, amount: str = "weight") -> DataFrame:
    """dimension, category, share (the target) and reached: what the cells' amounts make of it."""
    sums = _by_dimension(cells, amount).withColumn("reached", F.col(amount) / F.sum(amount).over(W.partitionBy("dimension"))).drop(amount)
    return targets.select("dimension", "category", "share").join(sums, ["dimension", "category"], "left").fillna(0.0, ["reached"])


def _scaled(total: Column, share: Column) -> Column:
    return F.when(total > 0, F.col("weight") * share / total).otherwise(0.0)


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: shares that sum to 1 and meet the target marginals within the tolerance.

    Marginals are compared after every so many rounds. Targets that no weights can meet end after ``MOST_STEPS`` times as many.
    """
    for d in DIMENSIONS:
        own = targets.where(F.col("dimension") == d).select(F.col("category").alias(d), F.col("share").alias(f"{d}_share"))
        cells = cells.join(own, d, "left").fillna(0.0, [f"{d}_share"])
    cells = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    met = targets.join(_by_dimension(cells, "tokens"), ["dimension", "category"], "left_semi")  # a category without tokens can't be met
    met = materialize(met.withColumn("share", F.col("share") / F.sum("share").over(W.partitionBy("dimension"))), "met-targets")
    one_task = cells.count() <= ONE_TASK_CELLS
    for _ in range(MOST_STEPS):
        if one_task:
            cells = cells.coalesce(1)
        for _ in range(rounds):
            for d in DIMENSIONS:
                if one_task:
                    cells = cells.withColumn("weight", _scaled(F.sum("weight").over(W.partitionBy(d)), F.col(f"{d}_share")))
                else:
                    sums = cells.groupBy(d).agg(F.sum("weight").alias("total"))
                    cells = materialize(cells.join(sums, d).withColumn("weight", _scaled(F.col("total"), F.col(f"{d}_share"))).drop("total"), "cells")
        cells = materialize(cells, "cells")
        off = residuals(cells, met).agg(F.max(F.abs(F.col("reached") - F.col("share")))).first()[0]
        if off is None or off <= tolerance:
            break
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    return cells.select(*DIMENSIONS, "tokens", (F.col("weight") / (total if total > 0 else 1.0)).alias("weight"))


def rates(raked: DataFrame, keep: float = KEEP, budget: float | None = None) -> DataFrame:
    """Each cell's probability, min(1, c * weight / tokens), with c such that the expected tokens meet the budget.

    Cells at 1 are taken out of the budget and c is found again for the rest, until no more cells reach 1.
    """
    rate, c = F.col("weight") / F.col("tokens"), 0.0
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    wanted = keep * total if budget is None else budget
    while wanted < total:
        full = rate * c >= 1
        whole, rest = raked.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        now = (wanted - whole) / rest if rest > 0 else c
        if now <= c * (1 + 1e-12):
            break
        c = now
    probability = F.least(F.lit(1.0), c * rate) if wanted < total else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)
    return raked.select(*DIMENSIONS, "tokens", "weight", probability.alias("probability"))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by the id, or by the text where there is none."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cell_rates(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, temper: float = TEMPER, rounds: int = ROUNDS, keep: float = KEEP, budget: float | None = None) -> DataFrame:
    """source, lang, topic, tokens, weight, probability of every cell of docs."""
    cells = materialize(cell_tokens(with_cells(docs, topic)), "cell-tokens")
    return materialize(rates(rake(cells, tempered_targets(cells, temper) if targets is None else targets, rounds), keep, budget), "rates")


def mix(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, **settings) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (of its cell), probability, kept of every document."""
    raked = cell_rates(docs, targets, topic, **settings).drop("tokens")
    out = with_cells(docs, topic).join(raked, list(DIMENSIONS), "left")
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0)))
    return out.select("doc_id", *DIMENSIONS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), (F.col("draw") < p).alias("kept"))


def sampled(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, **settings) -> DataFrame:
    """The rows of docs that the mix keeps, with all their columns."""
    raked = cell_rates(docs, targets, topic, **settings)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs clashes with those of the cells
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(row, *[c.alias(d) for d, c in categories(topic).items()], n_tokens(text).alias("n"), draw(F.col("doc_id"), text).alias("draw"))
    return own.join(raked, list(DIMENSIONS), "left").where((F.col("draw") < F.coalesce("probability", F.lit(0.0))) | (F.col("n") == 0)).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.withColumns({"weight": F.round("weight", 9), "probability": F.round("probability", 9)})


def mixing_sql(docs: str = "documents", rounds: int = ROUNDS, temper: float = TEMPER, keep: float = KEEP) -> str:
    """The same in DuckDB SQL, over the table docs, where so many rounds are enough."""
    parts = [f"""
own AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'licen') THEN 'legal' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM {docs}
), c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM own GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for d in DIMENSIONS:
        power = 1.0 if d == "topic" else temper
        parts.append(f"t_{d} AS (SELECT {d}, r / sum(r) OVER () AS share FROM (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {power}) AS r FROM c GROUP BY {d}))")
    parts.append("w0 AS (SELECT source, lang, topic, tokens, tokens AS weight FROM c)")
    last = "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            now = f"w{i}_{d}"
            parts.append(f"{now} AS (SELECT source, lang, topic, tokens, weight * share / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {last} JOIN t_{d} USING ({d}))")
            last = now
    return "WITH " + ", ".join(parts) + f""", shares AS (
  SELECT source, lang, topic, tokens, weight / (sum(weight) OVER ()) AS weight FROM {last}
), ranked AS (
  SELECT *, weight / tokens AS rate, {keep} * sum(tokens) OVER () AS wanted, sum(tokens) OVER (ORDER BY weight / tokens DESC ROWS UNBOUNDED PRECEDING) - tokens AS whole,
         sum(weight) OVER (ORDER BY weight / tokens ROWS UNBOUNDED PRECEDING) AS rest FROM shares
), r AS (
  SELECT source, lang, topic, weight, least(1.0, rate * (SELECT max((wanted - whole) / rest) FILTER ((wanted - whole) / rest * rate <= 1) FROM ranked)) AS p FROM ranked
), o AS (
  SELECT doc_id, own.source, own.lang, own.topic, text, tokens, coalesce(r.weight, 0) AS weight, CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(p, 0) END AS probability
  FROM own LEFT JOIN r ON own.source = r.source AND own.lang = r.lang AND own.topic = r.topic
)
SELECT doc_id, source, lang, topic, tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM o"""


OP4_SQL = mixing_sql()
