"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased; its hash is two independent
64-bit hashes. A run is a bucketed table of (h1, h2, n_docs, last_doc), sorted by hash within its buckets: the number of
documents that hold a key and the largest id among them. No key stands in two runs.

Each new batch of documents is summed to its keys and merge-joined with every run. Runs and batch lie in the same
buckets, so no row moves. Keys that no run knows (the anti-join) become the batch's own run at level 0; known keys
become its changes. ``FANOUT`` runs of a level are merged into one of the next, and their changes summed. So a key is written
once and merged a logarithmic number of times, and a logarithmic number of tables is read, however many batches there were.

Documents are then anti-joined: a key of ``min_chars`` code points or more in at least ``min_docs`` documents loses
all its lines but in the largest id that holds it. Frequent keys come from the changes and the runs' rows of the same keys.

Counts are summed before they are shuffled, so a line that every document holds costs one row per task. Lines are split
and hashed once; texts meet their dropped keys in one join by id and a hash of the text, which spreads rows without an id.

Edge cases: null or empty text is one empty line; a null id is smaller than any other, and keys that only rows without
an id hold keep their lines; each of the rows of a repeated id counts as a document; an empty table gives no row;
further columns are ignored. A text of very many lines is one row throughout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import SnapshotConflict, _commit, _files, _last
from .common import ASCII_LOWER, ASCII_UPPER, WHITE, ascii_lower, fresh_path, id_and_text, materialize, read, shuffle_partitions

FANOUT, BATCHES = 4, 5
RUN = "h1 long, h2 long, n_docs long, last_doc long"
KEYS = "doc_id long, text_hash long, h1 long, h2 long, added string, batch int"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def line_key(line: Column) -> Column:
    """Pure ASCII lines take the faster of two equal ways."""
    bare = stripped(line)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row (h1, h2 and all columns but text) for each document and distinct key of at least min_chars code points in it."""
    rest = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.split("text", "\n"), lambda x: F.char_length(stripped(x)) >= min_chars)
    return docs.select(*rest, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key")).select(*rest, key_hash(F.col("key")).alias("h")).select(*rest, "h.h1", "h.h2")


def with_hash(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))


class LineRuns:
    """The runs below a folder: by level, the names of tables that hold a run (known = false) and the changes that came with it (known = true).

    Each add ends with a numbered manifest of the tables, so a later session goes on from the folder alone, and one that failed on the way
    leaves the last manifest's state. Every name is new, so of two that add at once one fails and spoils nothing. What a merge replaces is
    deleted after the manifest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "line-runs")).rstrip("/")
        self.number, state = _last(spark, self.path)
        state = state or {"levels": [[]], "buckets": shuffle_partitions(spark), "added": []}
        self.levels, self.buckets, self.added = state["levels"], state["buckets"], state["added"]
        self.replaced: list[str] = []

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _place(self, df: DataFrame) -> str:
        """df as a bucketed table in the shared folder, one sorted file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").partitionBy("known")
        writer.format("parquet").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _read(self, name: str, known: bool) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session, or closed
            self.spark.sql(f"CREATE TABLE `{name}` ({RUN}, known boolean) USING parquet PARTITIONED BY (known) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name).where(F.col("known") if known else ~F.col("known")).select("h1", "h2", "n_docs", "last_doc")

    def runs(self) -> list[DataFrame]:
        return [self._read(name, False) for name in self.names()]

    def changes(self) -> list[DataFrame]:
        return [self._read(name, True) for name in self.names()]

    def add(self, docs: DataFrame, min_chars: int, batches: int = 1) -> None:
        """Adds docs in batches by a hash of the id. Their lines are split and hashed once, before the first batch."""
        if _last(self.spark, self.path)[0] != self.number:  # its merges may have deleted what this one would read
            raise SnapshotConflict(f"another has added to {self.path} since it was opened")
        dealt = with_hash(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
        self.added = [*self.added, uuid.uuid4().hex]
        document_keys(dealt, min_chars).write.partitionBy("batch").parquet(f"{self.path}/keys/added={self.added[-1]}")
        keys = self.keys().where(F.col("added") == self.added[-1])
        for b in range(batches):
            self._add_batch(keys.where(F.col("batch") == b))
        _commit(self.spark, self.path, self.number + 1, {"levels": self.levels, "buckets": self.buckets, "added": self.added})
        self.number += 1
        self._drop(self.replaced)
        for name in self.replaced:
            fs, at = _files(self.spark, f"{self.path}/{name}")
            fs.delete(at, True)
        self.replaced = []

    def keys(self) -> DataFrame:
        """The keys of the documents of all adds; those of one that failed stay out."""
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/keys").where(F.col("added").isin(self.added))

    def _add_batch(self, keys: DataFrame) -> None:
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            own = own.join(run.select("h1", "h2", F.lit(True).alias(f"in_{i}")), ["h1", "h2"], "left")
            known = known | F.col(f"in_{i}").isNotNull()
        self.levels[0].append(self._place(own.select("h1", "h2", "n_docs", "last_doc", known.alias("known"))))
        self._compact()

    def _compact(self) -> None:
        """Merges the runs of a full level to one of the next, and sums their changes to one row for each key."""
        level = 0
        while len(self.levels[level]) >= FANOUT:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            runs, changes = ([self._read(name, known) for name in full] for known in (False, True))
            merged = _union(runs).withColumn("known", F.lit(False)).unionByName(_summed(_union(changes)).withColumn("known", F.lit(True)))
            self.levels[level + 1].append(self._place(merged))
            self.replaced += full
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys in at least min_docs documents, over all runs and changes."""
        rows = self.spark.createDataFrame([], RUN)
        for changed in self.changes():
            rows = rows.unionByName(changed)
        again = rows.select("h1", "h2", F.lit(True).alias("again")).distinct()
        for run in self.runs():
            rows = rows.unionByName(run.join(again, ["h1", "h2"], "left").where(F.col("again") | (F.col("n_docs") >= min_docs)).drop("again"))
        return _summed(rows).where(F.col("n_docs") >= min_docs)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def close(self) -> None:
        """Takes the tables' names out of the catalog; their files stay, so the folder can be opened again."""
        self._drop([*self.names(), *self.replaced])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def anti_join(docs: DataFrame, runs: LineRuns, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, kept (text), n_lines, n_dropped of every row of docs, which have been added to the runs."""
    docs = with_hash(docs)
    gone = (
        runs.keys().join(materialize(runs.frequent(min_docs), "frequent-lines"), ["h1", "h2"])
        .where("last_doc is not null and not (doc_id <=> last_doc)")
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    )
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~((F.char_length(stripped(x)) >= min_chars) & F.array_contains(F.col("gone"), key_hash(line_key(x)))))
    return (
        docs.join(gone, (F.col("text_hash") == F.col("gone_hash")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
        .select("doc_id", lines.alias("lines"), F.when(F.col("gone").isNull(), lines).otherwise(kept).alias("left"))
        .select("doc_id", F.array_join("left", "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """Adds docs to fresh runs, batch by batch, then dedups docs against them."""
    runs = LineRuns(docs.sparkSession)
    runs.add(docs, min_chars, batches)
    kept = anti_join(docs, runs, min_chars, min_docs)  # the frequent keys are written by then
    runs.close()
    return kept


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ASCII_UPPER}', '{ASCII_LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.last_doc AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
