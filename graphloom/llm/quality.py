"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a short vector of logarithms and rates (length, word shape, symbols, case, repetition). Class means
and covariances are sums over the labelled rows of all tasks, so fitting sends the driver a few numbers however many
rows there are. A class covariance is shrunk towards the pooled one and that towards its diagonal; its Cholesky factor
is computed once and goes to the tasks. The score is the posterior of label 1: the logistic of the difference of the
two Mahalanobis log densities plus the log prior odds.

Edge cases: null text is empty and is scored; a null id is held out; repeated ids are scored row by row; a very long text is read whole; without
labelled rows of both classes the score is the share of label 1 among them (0.5 without any); an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, in_slices, read, training_rows

#: At most about so many labelled rows are used to fit.
FIT_ROWS = 200_000
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "log_word_chars", "word_chars_spread", "upper", "digits", "marks", "symbols", "bars", "short_words", "symbol_words",
    "distinct_words", "lines", "distinct_lines", "ends_marked", "top_byte",
)
#: Rates are smoothed towards a typical value as if the text had so many more characters, words and lines of it: short texts say little.
MORE_CHARS, MORE_WORDS, MORE_LINES = 60.0, 12.0, 4.0
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~!"
_MARKS = b".,;:?'\"()-"


def _classes() -> np.ndarray:
    """Per byte: 0 other, 1 upper-case A-Z, 2 digit, 3 mark, 4 symbol, 5 white space."""
    kind = np.zeros(256, np.uint8)
    for k, chars in ((1, bytes(range(65, 91))), (2, b"0123456789"), (3, _MARKS), (4, _SYMBOLS), (5, b" \t\n\x0b\x0c\r")):
        kind[list(chars)] = k
    return kind


def statistics(text: str, kind: np.ndarray) -> list[float]:
    """The transformed statistics of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(data, np.uint8)
    own = kind[raw]
    counts, each = np.bincount(own, minlength=6).astype(float), np.bincount(raw, minlength=256)
    words, lines = data.split(), data.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    solid, n = max(1.0, len(data) - counts[5]), len(words)
    last = own[np.flatnonzero(np.append((own[:-1] != 5) & (own[1:] == 5), own[-1] != 5))]

    def chars(count, usual):
        return math.sqrt((count + MORE_CHARS * usual) / (solid + MORE_CHARS))

    def of_words(count, usual):
        return math.sqrt((count + MORE_WORDS * usual) / (n + MORE_WORDS))

    return [
        math.log(len(data) + MORE_CHARS), math.log((solid + MORE_WORDS * 5) / (n + MORE_WORDS)), math.log1p(lengths.std() * n / (n + MORE_WORDS)),
        chars(counts[1], 0.02), chars(counts[2], 0.005), chars(counts[3], 0.03), chars(counts[4], 0.001), chars(each[124], 0.001),
        of_words((lengths <= 3).sum(), 0.3), of_words((last == 4).sum(), 0.01), math.log((len(set(words)) + MORE_WORDS) / (n + MORE_WORDS)),
        math.sqrt((len(lines) + MORE_WORDS * 0.05) / (n + MORE_WORDS)), math.log((len(set(lines)) + MORE_LINES) / (len(lines) + MORE_LINES)),
        of_words((last == 3).sum(), 0.15), chars(each[33:].max(), 0.12),
    ]


def _matrix(texts: list[str]) -> np.ndarray:
    kind = _classes()
    return np.array([statistics(t, kind) for t in texts], float).reshape(len(texts), len(STATISTICS))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: count, sum and sum of outer products of the statistics, over rows (text, y)."""
    k = len(STATISTICS)

    def sums(batches):
        total = {}
        for batch in batches:
            x, y = _matrix(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                own = x[y == label]
                part = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                total[label] = total[label] + part if label in total else part
        labels = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([total[v].tolist() for v in labels], pa.list_(pa.float64()))], ["y", "sums"])

    each = rows.select("text", "y").mapInArrow(sums, "y int, sums array<double>").select("y", F.posexplode("sums").alias("i", "v"))
    out: dict[int, np.ndarray] = {}
    for r in each.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 (1 + k + k * k) numbers
        out.setdefault(r.y, np.zeros(1 + k + k * k))[r.i] = r.v
    return {y: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for y, v in out.items() if v[0]}


class QuadraticDiscriminant:
    """alpha: weight of the pooled covariance in a class covariance. gamma: weight of its diagonal."""

    def __init__(self, sums: dict, alpha: float = 0.1, gamma: float = 0.05):
        n = {y: s[0] for y, s in sums.items()}
        self.share = n.get(1, 0.0) / sum(n.values()) if n else 0.5
        self.parts = []
        if len(n) < 2:
            return
        scatter = {y: s[2] - np.outer(s[1], s[1]) / s[0] for y, s in sums.items()}
        pooled = sum(scatter.values()) / sum(n.values())
        for y in (0, 1):
            cov = (1 - alpha) * scatter[y] / n[y] + alpha * pooled
            cov = (1 - gamma) * cov + gamma * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((sums[y][1] / n[y], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), math.log(n[y] / sum(n.values()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        density = [prior - logdet - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, logdet, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> QuadraticDiscriminant:
    return QuadraticDiscriminant(moments(training_rows(docs, labels, "quality", max_rows)))


def scored(docs: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(apply, "doc_id long, score double")


def accepted(docs: DataFrame, model: QuadraticDiscriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more."""
    at = docs.columns.index("text")

    def keep(batches):
        for batch in in_slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.score(_matrix(texts)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
