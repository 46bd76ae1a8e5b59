"""Whitening against a plain version in exact fractions, and edge rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import registry, whitening

SF = "/root/testdata/sf0.01"
NAMES = [f.split()[0] for f in whitening.OUT.split(", ")]


def plain(rows, components=16):
    """Of (vec_id, list) rows of one length: n, {id: deviation}, covariance as fractions, integer rows."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = [list(v) for v in {tuple(v) for _, v in x}]
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    d = [[Fraction(n * v - s, n) for v, s in zip(row, sums)] for row in fit]
    k = len(sums)
    cov = [[sum(r[i] * r[j] for r in d) / n for j in range(k)] for i in range(k)]
    deviation = [(i, sum((n * v - s) ** 2 for v, s in zip(row, sums))) for i, row in x]
    return n, sums, cov, deviation, x


def hold(got, rows, components=16):
    n, sums, cov, deviation, x = plain(rows)
    v = np.array([[float(c) for c in row] for row in cov])
    k = min(components, len(sums))
    by_row = [got[i : i + k] for i in range(0, len(got), k)]
    assert len(got) == len(rows) * k and all([r.component for r in own] == list(range(1, k + 1)) for own in by_row)
    assert sorted(((own[0].vec_id, own[0].deviation_digits) for own in by_row), key=str) == sorted(((i, str(d)) for i, d in deviation), key=str)
    assert {r.n for r in got} == {n}
    values = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    assert np.allclose([r.explained for r in by_row[0]], values / np.trace(v), rtol=1e-9)
    # Each component's column is an eigenvector's: V applied to the axis that the rows imply gives the axis back
    w = np.array([[r.whitened for r in own] for own in by_row])
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for _, row in sorted(x, key=lambda r: r[0])])
    order = np.argsort([own[0].vec_id for own in by_row], kind="stable")
    axes = np.linalg.lstsq(centred, w[order] * np.sqrt(values), rcond=None)[0]
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-8) and np.allclose(v @ axes, axes * values, atol=1e-7 * values[0])
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error <= 1e-9


def test_query_against_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    hold(sorted(registry.QUERIES["op11_whitening"](spark, SF).collect(), key=lambda r: (r.vec_id, r.component)), rows)


SCHEMA = "vec_id long, embedding array<double>, label int, n long, x string"


def whiten(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    out = whitening.whiten(df)
    assert out.columns == NAMES
    return sorted(out.collect(), key=lambda r: (r.vec_id is not None, r.vec_id, r.component))


def test_limbs_are_exact():
    """Sums of products far beyond 2**53, against Python integers."""
    rng = np.random.default_rng(3)
    for bits in (10, 40, 61, 75, 200):
        d = np.array([[int(rng.integers(2**30)) * 2 ** (bits - 30) * (-1) ** int(rng.integers(2)) + 1 if bits > 30 else int(rng.integers(-(2**bits), 2**bits)) for _ in range(3)] for _ in range(50)], object)
        gram = whitening.Gram(3)
        for _ in range(3):
            gram.add(d.astype(np.int64) if bits < 62 else d)
        assert gram.recombine().tolist() == [[3 * sum(r[i] * r[j] for r in d.tolist()) for j in range(3)] for i in range(3)]


def test_full_blocks_of_the_largest_limbs_are_exact():
    d = np.full((whitening.BLOCK * (whitening.HELD + 2), 2), 2 ** (3 * whitening.LIMB) - 1, np.int64)
    d[:, 1] *= -1
    gram = whitening.Gram(2)
    gram.add(d)
    v = len(d) * int(d[0, 0]) ** 2
    assert gram.recombine().tolist() == [[v, -v], [-v, v]]


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [0.0, float("inf"), 0.0])]
    again = [(3, good[3][1]), (None, good[4][1]), (50, good[5][1])]
    got = whiten(spark, [*good, *bad, *again])
    assert len(got) == 3 * (len(good) + len(again)) and {r.n for r in got} == {30} and sum(r.vec_id is None for r in got) == 3
    assert [r.whitened for r in got if r.vec_id is None] == [r.whitened for r in got if r.vec_id == 4]
    hold(whiten(spark, good), good)


def test_extremes(spark):
    huge = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3.0, 1e9])]
    got = whiten(spark, huge)
    n, sums, _, deviation, _ = plain([(i, [max(min(c, 2.0**56), -(2.0**56)) for c in v]) for i, v in huge])
    assert [(r.vec_id, r.deviation_digits) for r in got[::2]] == [(i, str(d)) for i, d in deviation] and got[0].deviation is None
    assert got[0].identity_error < 1e-9
    one = whiten(spark, [(7, [1.0, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whiten(spark, [(i, [float(i), 5.0]) for i in range(4)])
    assert [r.whitened is None for r in flat] == [False, True] * 4 and flat[0].explained == pytest.approx(1) and flat[0].identity_error < 1e-9


def test_lengths_are_populations_of_their_own(spark):
    rng = np.random.default_rng(6)
    two, three = [(i, rng.normal(size=2).tolist()) for i in range(20)], [(100 + i, rng.normal(size=3).tolist()) for i in range(25)]
    got = whiten(spark, [*two, *three])
    hold([r for r in got if r.vec_id < 100], two)
    hold([r for r in got if r.vec_id >= 100], three)


def test_empty(spark):
    assert whiten(spark, []) == []
