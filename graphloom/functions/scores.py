"""Match scores of symbols against a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import after_colon, container_prefix, ends_with_ci, equals_ci, fold_ci, trailing_identifier
from .paths import test_path


def _ends(a: Column, b: Column) -> Column:
    return F.coalesce(ends_with_ci(a, b), F.lit(False))


def _has(a: Column, b: Column) -> Column:
    return F.coalesce(fold_ci(a).contains(fold_ci(b)), F.lit(False))


def _is(a: Column, b: Column) -> Column:
    return F.coalesce(equals_ci(a, b), F.lit(False))


def node_match_score(query: Column, documentation_id: Column, metadata_name: Column, display_name: Column) -> Column:
    """The best of the arms: documentation id, its payload, metadata name, display name."""
    payload = after_colon(documentation_id)
    arms = [
        (F.coalesce(documentation_id == query, F.lit(False)), 300), (_is(payload, query), 280), (_ends(payload, query), 240), (_has(payload, query), 180),
        (_is(metadata_name, query), 160), (_has(metadata_name, query), 120), (_is(display_name, query), 140), (_has(display_name, query), 100),
    ]
    return F.greatest(*[F.when(test, n).otherwise(0) for test, n in arms])


def identity_match(query: Column, documentation_id: Column, metadata_name: Column, display_name: Column) -> Column:
    """0: the query is the documentation id or its payload; 1: a simple name match; 2: any other match."""
    payload = after_colon(documentation_id)
    return F.when((documentation_id == query) | _is(payload, query), 0).when(_is(metadata_name, query) | _is(display_name, query), 1).otherwise(2)


def symbol_search_score(query: str, name: Column, container: Column, path: Column) -> Column:
    """Sum over qualified name, name, simple name, container and path; a test path costs 100."""
    q = F.lit(query.strip())
    simple, prefix = trailing_identifier(q), container_prefix(q)
    has_container = F.coalesce(F.trim(container), F.lit("")) != ""
    qualified = F.when(has_container, F.concat_ws(".", container, name)).otherwise(name)
    score = F.when(qualified == q, 1000).when(_is(qualified, q), 950).when(_ends(qualified, q), 700).otherwise(0)
    score += F.when(name == q, 700).when(_is(name, q), 650).when(fold_ci(name).startswith(fold_ci(q)), 450).when(_has(name, q), 250).otherwise(0)
    score += F.when(simple != q, F.when(name == simple, 600).when(_is(name, simple), 550).otherwise(0)).otherwise(0)
    score += F.when(prefix.isNotNull() & has_container, F.when(container == prefix, 500).when(_is(container, prefix), 475).when(_ends(container, prefix), 300).otherwise(0)).otherwise(0)
    score += F.when(path_matches(query, path), 400).otherwise(0)
    return score - F.when(test_path(path), 100).otherwise(0)


def path_matches(query: str, path: Column) -> Column:
    """The dotted query occurs in the path, each dot as itself or as a separator."""
    import re

    q = query.strip()
    if "." not in q:
        return F.lit(False)
    return path.rlike("(?i)" + "[./\\\\]".join(re.escape(p) for p in q.split(".")))
