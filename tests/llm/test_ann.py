import numpy as np

from graphloom.llm import ann

KIND = "vec_id long, embedding array<float>, label int, score double, rank int"


def plain(vectors, queries, k):
    out = {}
    for q, x in queries:
        x = np.array(x, np.float32).astype(float)
        near = []
        for i, y in vectors:
            if i != q:
                y = np.array(y, np.float32).astype(float)
                near.append((-(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), i))
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0, 1) for i, v in rows], KIND)


def test_recall_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(1500, 32))
    vectors = frame(spark, list(enumerate(x)))
    got = {}
    for r in ann.search(vectors, ann.usable_vectors(vectors).where("vec_id % 50 = 0"), block_rows=400, query_rows=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = plain(list(enumerate(x)), [(i, x[i]) for i in range(0, 1500, 50)], 5)
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    assert sum(len(set(got[q].values()) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_recall_of_the_query(spark):
    """Against every pair of the table, and exact scores."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = np.array(list(rows)), ann.unit(np.array(list(rows.values())))
    got, hits = {}, 0
    for r in ann.op5_ann(spark, "/root/testdata/sf0.1").collect():
        a, b = rows[r.query_id], rows[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == asked and all(len(v) == 5 for v in got.values())
    for q in asked:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -2
        hits += len(got[q] & set(ids[np.argsort(-score)[:5]].tolist()))
    assert hits >= 0.98 * 5 * len(asked)


def test_vectors_of_each_length_are_searched(spark):
    vectors = frame(spark, [(i, [1.0, i / 10]) for i in range(6)] + [(i, [1.0, 1.0, i / 10]) for i in range(50, 53)] + [(100, [1.0])])
    got = {}
    for r in ann.search(vectors, ann.usable_vectors(vectors).where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3], 50: [51, 52]}


def test_anisotropic_codes_keep_the_part_along_the_vector():
    x = ann.unit(np.random.default_rng(1).normal(size=(800, 16)))
    error = {}
    for threshold in (0.0, 0.4):
        q = ann.AnisotropicQuantiser(x, threshold=threshold)
        error[threshold] = np.abs(q._along(x, q.encode(x)).sum(axis=1)).mean()
    assert error[0.4] < error[0.0]


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9)] + [(20, [0.0, 1.0]), (21, None), (22, [0.0, 0.0]), (23, [None, 1.0]), (24, [float("nan"), 1.0]), (25, [float("inf"), 0.0]), (26, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    vectors = frame(spark, rows)
    got = {}
    for r in ann.search(vectors, ann.usable_vectors(vectors).where("vec_id in (0, 8, 20, 21)"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 8: [0, 1, 2, 3, 4], 20: [0, 1, 2, 3, 4]}


def test_repeated_query_rows(spark):
    x = np.random.default_rng(3).normal(size=(12, 4))
    rows = list(enumerate(x)) + [(0, x[0])] * 4 + [(1, x[1])] + [(7, x[0]), (7, x[7]), (0, -x[0])]
    vectors = frame(spark, rows)
    got = {}
    for r in ann.search(vectors, ann.usable_vectors(vectors).where("vec_id in (0, 1, 2)"), block_rows=5, query_rows=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    score = {}
    for q, a in rows:
        for v, b in rows:
            if q in (0, 1, 2) and v != q:
                s = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12)
                score[q, v] = max(s, score.get((q, v), s))
    assert got == {q: [v for v in sorted((v for p, v in score if p == q), key=lambda v: (-score[q, v], v))[:5]] for q in (0, 1, 2)}


def test_few_and_none(spark):
    vectors = frame(spark, [(0, [1.0, 2.0]), (50, [2.0, 1.0])])
    assert [(r.query_id, r.vec_id) for r in ann.search(vectors, ann.usable_vectors(vectors)).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    none = frame(spark, [])
    assert ann.search(none, ann.usable_vectors(none)).count() == 0


def test_extreme_doubles(spark):
    """Squares of these overflow or vanish; the cosines are right all the same."""
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1e-200]), (2, [1e200, 1e200]), (3, [-5e-324, 0.0]), (4, [1e308, 1e-308])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, vector array<double>"), 5).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(4, 1.0), (2, round(0.5**0.5, 12)), (1, 0.0), (3, -1.0)]


def test_recall_on_crowded_rows(spark):
    """Tight clusters of more rows than are reranked, a large common part, and entries of very different sizes: codes hardly tell these rows apart."""
    rng, n = np.random.default_rng(5), 2400
    kinds = {
        "clusters": rng.normal(size=(6, 32))[rng.integers(0, 6, n)] + 1e-3 * rng.normal(size=(n, 32)),
        "common part": 30 + rng.normal(size=(n, 32)),
        "sizes": rng.normal(size=(n, 32)) * 2.0 ** -np.arange(32) + (np.arange(32) == 0) * 50,
        "odd length": np.abs(rng.standard_cauchy(size=(n, 7))),
    }
    found = {}
    for kind, x in kinds.items():
        vectors = frame(spark, list(enumerate(x)))
        got = {}
        for r in ann.search(vectors, ann.usable_vectors(vectors).where("vec_id % 50 = 0"), block_rows=900, query_rows=30).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        want = plain(list(enumerate(x)), [(i, x[i]) for i in range(0, n, 50)], 5)
        found[kind] = sum(len({v for _, v in got[q]} & set(want[q])) for q in want) / (5 * len(want))
    assert min(found.values()) > 0.99, found
