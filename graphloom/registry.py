"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from .queries import graph, source, text

QUERIES: dict = {**graph.QUERIES, **text.QUERIES, **source.QUERIES}
ORACLES: dict[str, str] = {**graph.ORACLES, **text.ORACLES, **source.ORACLES}
