"""Embedding whitening with an exact covariance: digit-slice matrix products.

An entry c becomes the integer ``x = floor(64 * c) + 1000000``. The fit list is each distinct x vector once; with its
number n and sums S, ``d = n * x - S`` is n times the centred vector, without rounding. d is cut into limbs of
``LIMB`` bits, so that products of ``BLOCK`` rows of limbs are sums of integers below 2**53 and float64 BLAS gives them
exactly. The products of a task are put together as Python integers, tasks' matrices are merged row by row, and the
covariance ``sum(d * d') / n**3`` is rounded once, on its way into the eigendecomposition. What reaches the driver is
the matrix of one vector length, whose size doesn't depend on the number of rows.

Vectors of each length are a population of their own, with its own fit list and components.

Edge cases: a vector that is null or empty, or holds null or non-finite entries, takes no part; entries are held
within 2**62 before the shift, and arithmetic beyond 64 bits goes on in Python integers; a deviation beyond a long is
null (deviation_digits has it in full); a component whose variance is zero (a constant dimension, fewer vectors than
dimensions, a single vector) has null whitened and is left out of identity_error, which is 0 where all are; explained is
0 where all variance is; null and repeated ids are rows of their own; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Bits of a limb and rows of a product: 2 * LIMB + log2(BLOCK) must not be above 53.
LIMB, BLOCK = 20, 4096
#: So many blocks' products of limbs add up in 64 bits, for up to eight limbs.
HELD = 128
LONG = 2**63
OUT = "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(c, lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(2**62)), F.lit(-(2**62))) + SHIFT)
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("x"))


def by_length(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of the vectors of one batch: the rows' numbers, and a matrix of longs."""
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for k in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == k)
        out[k] = rows, flat[starts[rows, None] + np.arange(k)]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums without rounding: in 64 bits if no step can leave them, else as Python integers."""
    if n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """Signed digits of base 2**LIMB as float64 matrices, the lowest first."""
    sign, rest, out = np.where(d < 0, -1, 1), np.abs(d), []
    while not out or rest.any():
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64) * sign.astype(np.float64))
        rest = rest >> LIMB
    return out


class Gram:
    """The exact sum of d * d' over the rows that were added, as a matrix of Python integers."""

    def __init__(self, dims: int):
        self.total, self.held, self.blocks = np.zeros((dims, dims), object), defaultdict(int), 0

    def add(self, d: np.ndarray) -> None:
        for at in range(0, len(d), BLOCK):
            parts = limbs(d[at : at + BLOCK])
            for i, left in enumerate(parts):
                for j, right in enumerate(parts[: i + 1]):
                    product = (left.T @ right).astype(np.int64)
                    self.held[i + j] = self.held[i + j] + (product if i == j else product + product.T)
            self.blocks += 1
            if self.blocks == HELD or len(parts) > 8:
                self.recombine()

    def recombine(self) -> np.ndarray:
        for power, product in self.held.items():
            self.total = self.total + (product.astype(object) << (LIMB * power))
        self.held, self.blocks = defaultdict(int), 0
        return self.total


@dataclass
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray  # dims x components, unit columns
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def positive(self) -> np.ndarray:
        """Which components have a variance that isn't zero but for rounding."""
        return self.variances > len(self.axes) * np.finfo(float).eps * max(self.variances[0], 0.0)

    def whiten(self, d: np.ndarray) -> np.ndarray:
        """Rows of centred vectors -> whitened components; NaN where the variance is zero."""
        scale = np.where(self.positive, np.sqrt(np.where(self.positive, self.variances, 1.0)), np.nan)
        return (d / self.n).astype(float) @ self.axes / scale


def sizes_and_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: the number of fit vectors and the sums of their dimensions. Tasks send one row for each length."""

    def partial(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for k, (rows, x) in by_length(batch.column(0)).items():
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)  # neither leaves 64 bits for 2**31 rows
                own = found.setdefault(k, [0, [0] * k])
                own[0] += len(rows)
                own[1] = [s + (int(h) << 32) + int(v) for s, h, v in zip(own[1], high, low)]
        lengths = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array([found[k][0] for k in lengths], pa.int64()), pa.array([list(map(str, found[k][1])) for k in lengths], pa.list_(pa.string()))], ["dims", "n", "sums"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, column))) for column in zip(*parts["sums"])]
        return pd.DataFrame({"dims": parts["dims"].iloc[:1], "n": [int(parts["n"].sum())], "sums": [sums]})

    schema = "dims int, n long, sums array<string>"
    return {r.dims: (r.n, list(map(int, r.sums))) for r in fit.mapInArrow(partial, schema).groupBy("dims").applyInPandas(merge, schema).collect()}


def grams(fit: DataFrame, known: dict[int, tuple[int, list[int]]]) -> dict[int, list[list[int]]]:
    """Per length: sum of d * d' over the fit list. A task sends each row of its matrices once."""

    def partial(batches):
        found: dict[int, Gram] = {}
        for batch in batches:
            for k, (_, x) in by_length(batch.column(0)).items():
                found.setdefault(k, Gram(k)).add(centred(x, *known[k]))
        for k, gram in found.items():
            rows = [list(map(str, row)) for row in gram.recombine()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["dims", "row", "entries"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        entries = [str(sum(map(int, column))) for column in zip(*parts["entries"])]
        return pd.DataFrame({"dims": parts["dims"].iloc[:1], "row": parts["row"].iloc[:1], "entries": [entries]})

    schema = "dims int, row int, entries array<string>"
    out: dict[int, list] = {k: [None] * k for k in known}
    for r in fit.mapInArrow(partial, schema).groupBy("dims", "row").applyInPandas(merge, schema).collect():  # dims x dims numbers
        out[r.dims][r.row] = list(map(int, r.entries))
    return out


def decompose(n: int, sums: list[int], gram: list[list[int]], components: int) -> Whitening:
    """Python divides integers of any size with one rounding, so the covariance is the nearest matrix of doubles."""
    cov = np.array([[v / n**3 for v in row] for row in gram])
    values, axes = np.linalg.eigh(cov)
    falling = np.argsort(-values, kind="stable")[:components]
    trace = sum(gram[i][i] for i in range(len(gram))) / n**3
    values = np.maximum(values[falling], 0.0)
    return Whitening(n, sums, axes[:, falling], values, values / trace if trace else np.zeros(len(falling)))


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of (covariance of the whitened fit list - identity), from sums of products of centred values.

    The mean comes first: each task gives its sums, then, with the mean taken off, its products.
    """

    def sums_of(values_of, width):
        def partial(batches):
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, (_, x) in by_length(batch.column(0)).items():
                    model = models[k]
                    if model.positive.any():
                        own = values_of(k, model.whiten(centred(x, model.n, model.sums))[:, model.positive])
                        found[k] = found[k] + own if k in found else own
            lengths = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array([found[k].ravel().tolist() for k in lengths], pa.list_(pa.float64()))], ["dims", "sums"])

        each = fit.mapInArrow(partial, "dims int, sums array<double>").select("dims", F.posexplode("sums").alias("i", "v"))
        out: dict[int, dict[int, float]] = defaultdict(dict)
        for r in each.groupBy("dims", "i").agg(F.sum("v").alias("v")).collect():  # at most components x components numbers a length
            out[r.dims][r.i] = r.v
        return {k: np.array([own[i] for i in range(len(own))]).reshape(width(k)) / models[k].n for k, own in out.items()}

    size = {k: int(m.positive.sum()) for k, m in models.items()}
    mean = sums_of(lambda k, w: w.sum(axis=0), lambda k: (size[k],))
    cov = sums_of(lambda k, w: (w - mean[k]).T @ (w - mean[k]), lambda k: (size[k], size[k]))
    return {k: float(np.abs(c - np.eye(len(c))).max()) for k, c in cov.items()}


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """fit (x): distinct integer vectors -> the model of each length."""
    known = sizes_and_sums(fit)
    models = {k: decompose(*known[k], gram, components) for k, gram in grams(fit, known).items()}
    for k, error in identity_errors(fit, models).items():
        models[k].identity_error = error
    return models


def deviations(d: np.ndarray) -> list[int]:
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(axis=1).tolist()
    exact = d.astype(object)
    return (exact * exact).sum(axis=1).tolist()


def whitened(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """rows (vec_id, x) -> one row for each row and component."""
    names = [f.split()[0] for f in OUT.split(", ")]

    def apply(batches):
        for batch in batches:
            for k, (at, x) in by_length(batch.column(1)).items():
                model = models[k]
                d, m = centred(x, model.n, model.sums), model.axes.shape[1]
                w, exact = model.whiten(d), deviations(d)
                long = pa.array([v if v < LONG else None for v in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(len(at)), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * m, model.n, np.int64)),
                        long.take(each), pa.array(map(str, exact), pa.string()).take(each), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                        pa.array(np.tile(model.explained, len(at))), pa.array(np.full(len(at) * m, model.identity_error)),
                    ],
                    names,
                )

    return rows.mapInArrow(apply, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) -> OUT. The models are fitted here and now; the rows are computed when they are read."""
    rows = integer_vectors(vectors)
    with scratch(vectors.sparkSession):
        fit = materialize(rows.select("x").distinct(), "whitening-fit-list")
        models = fit_whitening(fit, components)
    return whitened(rows, models)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
