"""Table schemas and the fixed vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, kind string, display_name string, project_name string, owning_project_id string, file_path string, line int, character int, documentation_id string, metadata_name string"
EDGES = "kind string, source_id string, target_id string"
PROJECT_STATES = "project_id string, name string, file_path string, fingerprint string, referenced_project_ids array<string>"
#: What builds derive from source text; each row tells the project and the file that it comes from.
DERIVED = {
    "registrations": "service string, implementation string, lifetime string, path string, line int, source_text string, is_factory boolean, is_enumerable boolean, project_id string, project_name string",
    "consumers": "path string, line int, display string, parameter_types array<string>, project_id string, project_name string",
    "entrypoints": "category string, path string, line int, text string, project_id string, project_name string",
    "hosts": "project_id string, project_name string, path string, type string, program string",
}
FILES = "path string, content string"
DIAGNOSTICS = "uri string, start_line int, start_char int, end_line int, end_char int, severity int, code string, source string, message string"
SYMBOLS = "id string, parent_id string, name string, kind string, container_name string, path string, start_line int, start_char int, end_line int, end_char int"

# Node kinds with their selection priority, and edge kinds with theirs.
NODE_PRIORITY = {
    "Solution": 100, "Project": 95, "Entrypoint": 90, "DiRegistration": 85, "Type": 80, "Namespace": 75,
    "Method": 70, "Property": 68, "Event": 67, "Field": 65, "Document": 60,
}
EDGE_PRIORITY = {
    "depends_on_project": 100, "contains": 90, "registered_as": 85, "consumed_by": 80, "implements": 75,
    "inherits": 70, "overrides": 65, "calls": 60, "declared_in": 40,
}
OTHER_PRIORITY = 10
NOT_SYMBOLS = ("Solution", "Project", "Document", "DiRegistration", "Entrypoint")
SNAPSHOT_VERSION = 2
LAST_LINE = 2147483647  # stands in for a missing line when sorting


def priority(kind: Column, table: dict[str, int]) -> Column:
    """The kind's number in table, else OTHER_PRIORITY."""
    out = None
    for k, v in table.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(OTHER_PRIORITY)
