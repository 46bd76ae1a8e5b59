"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

Vectors are scaled to length one, so that the largest inner product is the largest cosine. Each subspace has 16
centres; codes and centres minimise the residual with its part along the vector weighted ``eta`` times (Guo et al.
2020), which is the part that changes large scores. Codebooks are fitted on a bounded sample; every row is indexed.

Equal vectors become one row with the k + 1 smallest ids, which is all that a list of k without the query itself can
need. Rows (codes of half a byte for each two dimensions, and vectors) and queries are dealt to blocks; each task scans the codes of one
block for one block of queries: per query a table of 16 scores for each subspace, two of which are read as one byte. Rows are
copied once for each ``QUERY_ROWS`` queries. Rows are dealt to blocks by hash, so a block's share of a query's best rows is even
but for chance, and each block scores its share of the best ``rerank_depth`` rows, with four deviations more, exactly.

Where rows crowd together (tight clusters, a large common part, few large entries) codes hardly tell them apart, and no fixed
depth holds the nearest. So the k-th score of that first scan is a bound for a second one. With each code stand the
residual's part along its vector and the length of the rest, from which follows the least approximate score that a row of
the bound or more can have (``least_approximate``). Each row that reaches it is scored exactly in double precision, so the
result is that of comparing all with all; how many rows these are depends on how well the codes tell rows apart.

Every code is compared with every query: a coarse partition of cells would save work where vectors cluster, but on
vectors without clusters half of all cells must be probed for nine of ten neighbours.

Edge cases: vectors that are null, zero or hold a null or non-finite component and rows without an id take no part; vectors
of each length are searched among themselves; ties go to the smaller id; repeated rows count once, and an id of
several vectors, as query or as row, is as near as its nearest one; with fewer than k candidates all are returned; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read, shuffle_partitions

CENTRES, FIT_ROWS = 16, 10_000
BLOCK_ROWS, QUERY_ROWS = 1 << 17, 1 << 13
#: Entries of the vectors of a block, and of the arrays that a task makes at a time.
BLOCK_ENTRIES, STEP_ENTRIES = 1 << 22, 1 << 20
RERANK, RERANK_ROWS, RERANK_POWER = 128, 8192, 0.4


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class AnisotropicQuantiser:
    """Product quantiser of unit vectors with 16 centres in each subspace of about two dimensions."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7):
        dim = sample.shape[1]
        subspaces = max(1, -(-dim // 2))
        self.edges = np.linspace(0, dim, subspaces + 1).astype(int)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        self.centres = [sample[rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES), a:b].copy() for a, b in self.spans()]
        for _ in range(4):  # plain k-means to begin with
            for m, (a, b) in enumerate(self.spans()):
                own, x = self._nearest(sample, m), sample[:, a:b]
                for c in np.unique(own):
                    self.centres[m][c] = x[own == c].mean(axis=0)
        codes = self.encode(sample)
        for _ in range(rounds):
            along = self._along(sample, codes)
            for m, (a, b) in enumerate(self.spans()):
                x, total = sample[:, a:b], along.sum(axis=1)
                rest = total - along[:, m] + (x * x).sum(axis=1)
                for c in np.unique(codes[:, m]):
                    own = codes[:, m] == c
                    xs = x[own]
                    left = own.sum() * np.eye(b - a) + (self.eta - 1) * xs.T @ xs
                    self.centres[m][c] = np.linalg.solve(left, xs.sum(axis=0) + (self.eta - 1) * (rest[own, None] * xs).sum(axis=0))
                along[:, m] = ((x - self.centres[m][codes[:, m]]) * x).sum(axis=1)
            codes = self.encode(sample, codes)

    def spans(self):
        return list(zip(self.edges[:-1], self.edges[1:]))

    def _nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        a, b = self.spans()[m]
        return ((x[:, None, a:b] - self.centres[m][None]) ** 2).sum(axis=2).argmin(axis=1)

    def _along(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's part of the residual along the vector."""
        return np.stack([((x[:, a:b] - self.centres[m][codes[:, m]]) * x[:, a:b]).sum(axis=1) for m, (a, b) in enumerate(self.spans())], axis=1)

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the weighted residual."""
        codes = np.stack([self._nearest(x, m) for m in range(len(self.centres))], axis=1) if codes is None else codes.copy()
        along = self._along(x, codes)
        for _ in range(sweeps):
            for m, (a, b) in enumerate(self.spans()):
                gap = x[:, None, a:b] - self.centres[m][None]
                part = (gap * x[:, None, a:b]).sum(axis=2)
                rest = along.sum(axis=1) - along[:, m]
                codes[:, m] = ((gap**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
                along[:, m] = part[np.arange(len(x)), codes[:, m]]
        return codes

    def residual(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector's residual the part along the vector, and the length of the rest."""
        gap = x - np.concatenate([self.centres[m][codes[:, m]] for m in range(len(self.centres))], axis=1)
        along = (gap * x).sum(axis=1)
        return along, np.sqrt(((gap - along[:, None] * x) ** 2).sum(axis=1))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Per query and byte of a packed code: the inner product with what the byte stands for."""
        own = [queries[:, a:b] @ self.centres[m].T for m, (a, b) in enumerate(self.spans())]
        if len(own) % 2:
            own.append(np.zeros_like(own[0]))
        return np.stack([(f[:, :, None] + s[:, None, :]).reshape(len(queries), CENTRES * CENTRES) for f, s in zip(own[::2], own[1::2])], axis=1).astype(np.float32)


def approximate(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The approximate score of each query and row."""
    score = np.zeros((len(tables), len(packed)), np.float32)
    for p in range(packed.shape[1]):
        score += tables[:, p].take(packed[:, p], axis=1)
    return score


def least_approximate(least: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The least approximate score of a row whose exact score is least or more.

    With score s, the query is s times the row's vector and a rest of length sqrt(1 - s^2), so the approximate score is at least
    s (1 - along) - across sqrt(1 - s^2), which is convex in s. What float32 sums round off is taken off.
    """
    lowest = -(1 - along) / np.maximum(np.hypot(1 - along, across), 1e-300)
    s = np.clip(np.maximum(least, lowest), -1, 1)
    return s * (1 - along) - across * np.sqrt(1 - s * s) - 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in double precision; equal rows give equal values.

    Rows are scaled by powers of two first, which rounds nothing, so that squares neither overflow nor vanish.
    """
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (q, x))
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector, ids (the k + 1 smallest), first: one row for each vector."""
    first = W.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("row", F.xxhash64("vector"))


def rerank_depth(n: int, least: int = RERANK) -> int:
    """Rows that are scored exactly for each query: more of them as n rows crowd nearer to each other."""
    return math.ceil(least * max(1.0, n / RERANK_ROWS) ** RERANK_POWER)


def block_depth(depth: int, n_blocks: int) -> int:
    """How many rows a block gives so that hardly any of the best depth rows over all blocks is missed."""
    share = depth / n_blocks
    return min(depth, math.ceil(share + 4 * math.sqrt(share) + 4))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit_quantiser(index: DataFrame, n: int, fit_rows: int = FIT_ROWS) -> AnisotropicQuantiser:
    """On a share of the n vectors, chosen by a hash, of about fit_rows rows at most."""
    share = index if n <= fit_rows else index.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    sample = share.orderBy("row").select("vector").toPandas()["vector"]
    return AnisotropicQuantiser(unit(np.stack(sample.to_numpy())))


def codes(index: DataFrame, quantiser: AnisotropicQuantiser) -> DataFrame:
    """row, ids, vector, code, along, across of every distinct vector."""

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(2)))
                own = quantiser.encode(x)
                packed = pa.array([c.tobytes() for c in quantiser.pack(own)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, *map(pa.array, quantiser.residual(x, own))], ["row", "ids", "vector", "code", "along", "across"])

    return index.select("row", "ids", "vector").mapInArrow(encode, "row long, ids array<long>, vector array<double>, code binary, along double, across double")


def nearest(query_id: int, score: list, ids: list, k: int) -> list[int]:
    """Places of the rows, of these scores and lists of ids, that the k nearest ids other than query_id can come from."""
    own = [[i for i in x if i != query_id] for x in ids]
    kept, found, ties, last = [], set(), set(), None
    for s, first, place in sorted((-s, x[0], place) for place, (s, x) in enumerate(zip(score, own)) if x):
        if len(found) >= k and (s != last or len(ties) >= k):
            break
        ties = ties | {first} if s == last else {first}
        found.update(own[place])
        kept.append(place)
        last = s
    return kept


def scanned(coded: DataFrame, asked: DataFrame, quantiser: AnisotropicQuantiser, n: int, k: int, depth: int, block_rows: int, query_rows: int) -> DataFrame:
    """asked_row, query_id, ids, score: rows near each query (asked_row, query_id, query, least) with exact scores, and all of its k nearest ids if least is known.

    Where least is null, a block scores its share of the depth rows of the largest approximate scores; else each row that can have
    the score least or more.
    """
    dim = int(quantiser.edges[-1])
    tasks = min(shuffle_partitions(coded.sparkSession), max(1, n // 4096))
    n_blocks = max(tasks, -(-n // max(1, min(block_rows, BLOCK_ENTRIES // dim))))
    n_parts = max(1, -(-asked.count() // max(1, min(query_rows, BLOCK_ENTRIES // dim))))
    most = block_depth(depth, n_blocks)

    def every(k):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    left = coded.withColumn("block", F.pmod("row", F.lit(n_blocks)).cast("int")).withColumn("part", every(n_parts))
    right = asked.withColumn("part", F.pmod("asked_row", F.lit(n_parts)).cast("int")).withColumn("block", every(n_blocks))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            packed, ids = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1), own["ids"]
            x, q = (np.stack(v.to_numpy()).astype(float) for v in (own["vector"], asked["query"]))
            along, across, least = own["along"].to_numpy(), own["across"].to_numpy(), asked["least"].to_numpy(float, na_value=np.nan)
            unit_x, unit_q, pairs = unit(x), unit(q), max(1, STEP_ENTRIES // dim)
            step = max(1, STEP_ENTRIES // max(len(own), packed.shape[1] * CENTRES * CENTRES))
            for at in range(0, len(q), step):
                score = approximate(quantiser.tables(unit_q[at : at + step]), packed)
                fits = score >= least_approximate(least[at : at + step, None], along[None], across[None])
                for i in np.flatnonzero(np.isnan(least[at : at + step])):
                    fits[i, np.argpartition(-score[i], min(most, len(own)) - 1)[:most]] = True
                i, j = np.nonzero(fits)
                i += at
                exact = np.zeros(len(i))
                for a in range(0, len(i), pairs):
                    some = slice(a, a + pairs)
                    near = ~((unit_q[i[some]] * unit_x[j[some]]).sum(axis=1) < least[i[some]] - 1e-9)
                    exact[some] = -2
                    exact[a + np.flatnonzero(near)] = cosines(q[i[some][near]], x[j[some][near]])
                fits = ~(exact < least[i]) & (exact > -2)
                i, j, exact = i[fits], j[fits], exact[fits]
                for at_query, places in pd.Series(np.arange(len(i))).groupby(i):
                    asked_row, query_id = asked["asked_row"].iat[at_query], asked["query_id"].iat[at_query]
                    lists, scores = [ids.iat[c].tolist() for c in j[places]], exact[places].tolist()
                    found += [(asked_row, query_id, lists[p], scores[p]) for p in nearest(query_id, scores, lists, k)]
        return pd.DataFrame(found, columns=["asked_row", "query_id", "ids", "score"])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, "asked_row long, query_id long, ids array<long>, score double")


def best_ids(scored: DataFrame, key: str, k: int) -> DataFrame:
    """key, vec_id, score, rank: the k nearest other ids of each key; an id of several vectors is as near as its nearest one."""
    pairs = scored.select("*", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy(key, "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _of_one_length(rows: DataFrame, asked: DataFrame, k: int, rerank: int, block_rows: int, query_rows: int) -> DataFrame:
    index = materialize(distinct_vectors(rows, k), "distinct-vectors")
    n = index.count()
    quantiser, depth = fit_quantiser(index, n), max(rerank_depth(n, rerank), k + 1)
    coded = materialize(codes(index, quantiser), "codes")
    queries = materialize(asked.withColumn("asked_row", F.xxhash64("query_id", "query")), "asked")
    first = scanned(coded, queries.withColumn("least", F.lit(None).cast("double")), quantiser, n, k, depth, block_rows, query_rows)
    bound = best_ids(first, "asked_row", k).where(F.col("rank") == k).select("asked_row", F.col("score").alias("least"))
    known = queries.join(bound, "asked_row", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return scanned(coded, materialize(known, "bounds"), quantiser, n, k, depth, block_rows, query_rows).drop("asked_row")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = RERANK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, vector) its k nearest other rows of vectors."""
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).distinct()
    scored = spark.createDataFrame([], "query_id long, ids array<long>, score double")
    for dim in sorted(r.dim for r in rows.select(F.size("vector").alias("dim")).distinct().collect()):
        own = asked.where(F.size("query") == dim)
        scored = scored.unionByName(_of_one_length(rows.where(F.size("vector") == dim), own, k, rerank, block_rows, query_rows))
    # an id with several vectors, as query or as row, meets the same neighbour more than once
    return best_ids(scored, "query_id", k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, usable_vectors(vectors).where("vec_id % 50 = 0"))
