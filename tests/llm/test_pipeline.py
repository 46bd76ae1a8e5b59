"""The pipeline against a plain version of each of its stages."""

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from test_decontaminate import as_text
from test_near_copies import brute_force
from test_token_output import expected

import corpus_pipeline
from graphloom.llm import decontaminate, mixing, quality

SF = "/root/testdata/sf0.001"


def plain_scores(x, y, test, alpha=0.1, gamma=0.05):
    """Posterior of label 1 under two shrunk Gaussians, by solving with the covariances themselves."""
    parts = {v: x[y == v] for v in (0, 1)}
    own = {v: np.cov(p.T, bias=True) for v, p in parts.items()}
    pooled = sum(len(p) * own[v] for v, p in parts.items()) / len(x)
    density = []
    for v, p in parts.items():
        c = (1 - alpha) * own[v] + alpha * pooled
        c = (1 - gamma) * c + gamma * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
        gap = test - p.mean(axis=0)
        density.append(np.log(len(p) / len(x)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(c, gap.T).T))
    return 1 / (1 + np.exp(density[0] - density[1]))


def test_run_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    items = [decontaminate.fold(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]]
    import zlib

    train = docs.merge(labels, on="doc_id")
    train = train[[zlib.crc32(str(d).encode()) % 5 != 0 for d in train["doc_id"]]]

    def statistics(texts):
        return np.array([quality.statistics(t, quality._classes()) for t in texts])

    docs = docs[plain_scores(statistics(train["text"]), train["quality"].to_numpy(), statistics(docs["text"])) >= 0.3]
    root = brute_force([(int(d), t) for d, t in zip(docs["doc_id"], docs["text"])])
    docs = docs[[root[d] == d for d in docs["doc_id"]]]
    docs = docs[[not any(as_text(i) in as_text(decontaminate.fold(t)) for i in items) for t in docs["text"]]]
    con = duckdb.connect()
    con.register("left_over", pd.DataFrame(docs))
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.mixing_sql('left_over')}) WHERE kept").fetchall()}
    docs = docs[docs["doc_id"].isin(kept)]
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([(int(d), t) for d, t in zip(docs["doc_id"], docs["text"])])
    assert np.all([r.n_tokens > 1 for r in got]) and public_tokenizers.path(corpus_pipeline.TOKENIZER)


def test_stages_keep_columns_and_survive_edge_rows(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert set(columns) <= set(docs.columns)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
