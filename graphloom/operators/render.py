"""Graph slices as Mermaid or DOT text. A slice has a bounded number of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import escape_dot, escape_mermaid

# Class names and colours by node kind.
CLASSES = {"Solution": "solution", "Project": "project", "Namespace": "namespace", "Type": "type", "Document": "document", "DiRegistration": "di", "Entrypoint": "entrypoint"}
COLOURS = {"Solution": "#f3f4f6", "Project": "#dbeafe", "Namespace": "#ede9fe", "Type": "#dcfce7", "Document": "#fee2e2", "DiRegistration": "#fce7f3", "Entrypoint": "#cffafe"}
SHAPES = {"Solution": "box", "Project": "box", "Namespace": "box", "Document": "note", "DiRegistration": "parallelogram", "Entrypoint": "hexagon"}


def _by_kind(table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("kind")), F.lit(other))


def label() -> Column:
    return F.concat(F.when(F.col("kind") == "DiRegistration", "DI").otherwise(F.col("kind")), F.lit(": "), "display_name")


def _joined(df: DataFrame, order: Column, line: Column) -> DataFrame:
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))), lambda x: x.t), "\n").alias("text"))


def edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    source = nodes.select(F.col("id").alias("source_id"), F.col("graph_id").alias("source"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("graph_id").alias("target"))
    return edges.join(source, "source_id").join(target, "target_id")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the text: nodes by number, edges by priority and ends, classes."""
    number = F.substring("graph_id", 2, 10).cast("int")
    n = _joined(nodes, number, F.concat(F.lit("  "), "graph_id", F.lit('["'), escape_mermaid(label()), F.lit('"]')))
    e = _joined(edge_ends(nodes, edges), F.struct(-F.col("priority"), "kind", "source_id", "target_id"), F.concat(F.lit("  "), "source", F.lit(" -->|"), escape_mermaid(F.col("kind")), F.lit("| "), "target"))
    c = _joined(nodes, number, F.concat(F.lit("  class "), "graph_id", F.lit(" "), _by_kind(CLASSES, "member"), F.lit(";")))
    parts = n.select(F.lit(1).alias("o"), "text").union(e.select(F.lit(2), "text")).union(c.select(F.lit(3), "text"))
    return _joined(parts, F.col("o"), F.col("text")).select(F.concat(F.lit("flowchart LR\n"), "text").alias("text"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    number = F.substring("graph_id", 2, 10).cast("int")
    style = F.concat(F.lit('", shape='), _by_kind(SHAPES, "ellipse"), F.lit(', fillcolor="'), _by_kind(COLOURS, "#fef3c7"), F.lit('"];'))
    n = _joined(nodes, number, F.concat(F.lit("  "), "graph_id", F.lit(' [label="'), escape_dot(label()), style))
    e = _joined(edge_ends(nodes, edges), F.struct(-F.col("priority"), "kind", "source_id", "target_id"), F.concat(F.lit("  "), "source", F.lit(" -> "), "target", F.lit(' [label="'), escape_dot(F.col("kind")), F.lit('"];')))
    parts = n.select(F.lit(1).alias("o"), "text").union(e.select(F.lit(2), "text"))
    return _joined(parts, F.col("o"), F.col("text")).select(F.concat(F.lit("digraph CodeGraph {\n  rankdir=LR;\n"), "text", F.lit("\n}")).alias("text"))
