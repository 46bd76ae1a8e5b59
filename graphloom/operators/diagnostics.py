"""Filters, counts and top-k over diagnostics (uri, severity 1 error .. 4 hint, code, source, message, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .graph import top_per_key

# Ranks of severity names; an unknown name counts as WARNING.
RANKS = {"ERROR": 4, "WARNING": 3, "INFO": 2, "INFORMATION": 2, "HINT": 1, "ALL": 0}


def severity_rank(severity: Column) -> Column:
    """4 error .. 1 hint for the numbers 1 .. 4; 0 without one."""
    return F.when(severity.between(1, 4), 5 - severity).otherwise(0)


def minimum_rank(name: str | None) -> int:
    return RANKS.get((name or "").strip().upper(), 3)


def filtered(rows: DataFrame, minimum: str = "ALL", exclude_codes=(), exclude_sources=(), exclude_paths=()) -> DataFrame:
    """Diagnostics of the minimum severity or above; codes and sources left out ignore case, and nulls stay."""
    out = rows.where(severity_rank(F.col("severity")) >= minimum_rank(minimum))
    for column, values in (("code", exclude_codes), ("source", exclude_sources)):
        if values:
            out = out.where(F.coalesce(~names.fold_ci(column).isin([names.fold_text(v) for v in values]), F.lit(True)))
    for part in exclude_paths:
        out = out.where(~names.fold_ci(F.coalesce("uri", F.lit(""))).contains(names.fold_text(part)))
    return out


def document_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("uri").agg(F.count("*").alias("n"))


def top_documents(rows: DataFrame, k: int) -> DataFrame:
    return document_counts(rows).orderBy(F.desc("n"), "uri").limit(max(1, k))


def top_per_document(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """The first k diagnostics of each document by position; tie settles equal positions."""
    return top_per_key(rows, ["uri"], [F.col("start_line"), F.col("start_char"), F.col(tie)], k)


def in_focus(rows: DataFrame, files: DataFrame | None) -> DataFrame:
    """Diagnostics of the focus files (path), ignoring case; all of them without a focus."""
    if files is None:
        return rows
    focus = files.select(names.fold_ci("path").alias("key")).distinct()
    return rows.join(focus, names.fold_ci("uri") == focus["key"], "left_semi")


def within_lines(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.where((F.col("start_line") >= first) & (F.col("end_line") <= last))


def latest(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The last row of each key by version."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(every, F.struct(version, tie)).alias("row")).select("row.*")


def edit_totals(edits: DataFrame) -> DataFrame:
    """(changes: map of uri to an array of edits) to edits per file."""
    return edits.select(F.explode("changes").alias("uri", "list")).groupBy("uri").agg(F.sum(F.size("list")).cast("long").alias("edits"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: the diagnostics and the documents that have any."""
    return rows.groupBy("uri").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("diagnostics"), F.count("*").alias("documents"))
