"""Mixing and line dedup: against SQL, against targets, edge rows."""

import hashlib

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, registry
from graphloom.sources.snapshot import SnapshotConflict

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    for name in sorted(registry.ORACLES):
        assert_same(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


def test_marginals_are_met(spark):
    """The rounds of the query meet the targets, and the expected tokens are the kept share of all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cells = mixing.cell_tokens(mixing.with_cells(docs))
    targets = mixing.tempered_targets(cells)
    raked = mixing.rake(cells, targets)
    worst = mixing.residuals(raked, targets).agg(F.max(F.abs(F.col("share") - F.col("reached")))).first()[0]
    assert worst <= mixing.TOLERANCE
    before = mixing.residuals(cells, targets, "tokens").agg(F.max(F.abs(F.col("share") - F.col("reached")))).first()[0]
    assert before > 20 * worst  # the targets ask for something
    out = mixing.mix(docs).agg(F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("tokens"))).alias("k"), F.sum("tokens").alias("n")).first()
    assert abs(out.e - mixing.KEEP * out.n) < 1e-6 * out.n and abs(out.e - out.k) < 0.1 * out.e


def test_a_rare_cell_moves_nothing_else(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', 50) as text", "if(id % 10 < 7, 'a', 'b') as source", "'en' as lang")
    odd = spark.createDataFrame([(5000, "w w w", None, "xx")], "doc_id long, text string, source string, lang string")
    alone = {r.source: r.probability for r in mixing.mix(docs).select("source", "probability").distinct().collect()}
    more = {r.source: r.probability for r in mixing.mix(docs.unionByName(odd)).select("source", "probability").distinct().collect()}
    assert more.pop(mixing.NONE) == 1.0 and all(abs(more[s] - p) < 0.01 for s, p in alone.items()) and alone["a"] < alone["b"]


def test_all_tasks_rake_as_one(spark, monkeypatch):
    cells = mixing.cell_tokens(mixing.with_cells(spark.read.parquet(f"{SF}/documents.parquet")))
    targets = mixing.tempered_targets(cells)
    one = {tuple(r[:3]): r.weight for r in mixing.rake(cells, targets, rounds=2).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    many = {tuple(r[:3]): r.weight for r in mixing.rake(cells, targets, rounds=2).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_own_targets_topic_and_budget(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('w ', 10) as text", "if(id % 2 = 0, 'a', 'b') as source", "'en' as lang")
    targets = spark.createDataFrame([("source", "a", 0.8), ("source", "b", 0.2), ("lang", "en", 1.0), ("topic", "x", 0.5), ("topic", "y", 0.5)], "dimension string, category string, share double")
    got = mixing.mix(docs, targets, topic=F.when(F.col("doc_id") < 500, "x").otherwise("y"), budget=4000.0)
    expected = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")).collect()}
    assert abs(expected["a"] - 3200) < 1 and abs(expected["b"] - 800) < 1


def test_mixing_edge_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.probability <= 1 for r in got)
    assert all(r.kept for r in got if r.tokens == 0)
    clashing = odd_docs.withColumns({c: F.lit(1) for c in ("topic", "probability", "n", "row", "draw", "weight")})
    kept = mixing.sampled(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.sampled(no_docs).count() == 0
    no_ids = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'a', 'b') as source", "'en' as lang")
    assert 0 < mixing.mix(no_ids).where("kept").count() < 400  # rows without an id draw one by one


def plain_dedup(rows, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(lower) for x in (t or "").split("\n")] for _, t in rows]
    n, last = {}, {}
    for (d, _), own in zip(rows, keys):
        for k in set(own):
            n[k] = n.get(k, 0) + 1
            last[k] = max(last.get(k, -(10**18)), -(10**18) if d is None else d)
    out = []
    for (d, t), own in zip(rows, keys):
        mine = -(10**18) if d is None else d
        left = [x for x, k in zip((t or "").split("\n"), own) if not (len(k) >= min_chars and n[k] >= min_docs and last[k] != mine)]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark, odd_docs):
    common = "A common line that goes on for more than forty characters"
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(100 + i, f"  {common.upper() if i % 2 else common}\t\nÉtait une ligne {'É' if i % 2 else 'é'} de plus de quarante caractères\nown {i}\n{common}") for i in range(7)] + [(None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_dedup(rows)


def test_batches_and_compaction_equal_one_pass(spark):
    rows = [(i, f"line number {i % 5} that many documents hold, forty characters\nx{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = line_dedup.LineRuns(spark)
    for b in range(6):
        runs.add(docs.where(F.col("doc_id") % 6 == b), 40)
    assert [len(level) for level in runs.levels] == [2, 1]
    held = [{(r.h1, r.h2) for r in run.collect()} for run in runs.runs()]
    assert sum(map(len, held)) == len(set().union(*held)) == 5  # the anti-join: no key is in two runs, and the batches after the first bring changes only
    changed = [c.agg(F.count("*"), F.sum("n_docs")).first() for c in runs.changes()]
    added = [sum(i % 6 == b for i in range(40)) for b in range(6)]
    assert [tuple(c) for c in changed] == [(5, added[4]), (5, added[5]), (5, sum(added[1:4]))]  # those of the first four batches are one table
    got = line_dedup.anti_join(docs, runs, 40, 5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_dedup(rows)


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def test_runs_are_opened_again(spark):
    before = tables(spark)
    rows = [(i, f"line number {i % 5} that many documents hold, forty characters\nx{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = line_dedup.LineRuns(spark)
    for b in range(3):
        first.add(docs.where(F.col("doc_id") % 6 == b), 40)
    first.close()
    assert tables(spark) == before  # no name is left
    other, late = line_dedup.LineRuns(spark, first.path), line_dedup.LineRuns(spark, first.path)
    assert other.names() == first.names() and len(other.added) == 3
    failed = line_dedup.LineRuns(spark, first.path)  # writes keys and a table, and stops before its manifest
    line_dedup.document_keys(line_dedup.with_hash(docs).withColumn("batch", F.lit(0)), 40).write.partitionBy("batch").parquet(f"{failed.path}/keys/added=cut")
    assert failed.keys().count() == sum(i % 6 < 3 for i in range(40))
    for b in range(3, 6):
        other.add(docs.where(F.col("doc_id") % 6 == b), 40)
    assert [len(level) for level in other.levels] == [2, 1]
    got = line_dedup.anti_join(docs, other, 40, 5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_dedup(rows)
    with pytest.raises(SnapshotConflict):  # another has added since it was opened
        late.add(docs, 40)
    again = line_dedup.anti_join(docs, line_dedup.LineRuns(spark, first.path), 40, 5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, again), key=str) == plain_dedup(rows)  # and loses nothing by it
    other.close()
    late.close()


def test_no_names_are_left(spark):
    before = tables(spark)
    docs = spark.createDataFrame([(i, "a line that many documents hold, of forty characters") for i in range(9)], "doc_id long, text string")
    assert line_dedup.line_dedup(docs).agg(F.sum("n_dropped")).first()[0] == 8 and tables(spark) == before


def test_no_documents(no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0
