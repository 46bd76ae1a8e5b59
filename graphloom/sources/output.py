"""Results at the edge: the JSON envelope of a query, and graph text files. Both take results that are small by nature."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame

# File extensions of the graph forms.
EXTENSIONS = {"mermaid": ".mmd", "dot": ".dot"}


def envelope(tool: str, result: DataFrame | None = None, summary: str = "", error: tuple[str, str] | None = None, most: int = 1000) -> str:
    """One JSON document: success with at most `most` rows as data, or an error's code and message; nulls are left out."""
    out = {"schemaVersion": 1, "tool": tool, "success": error is None, "summary": summary}
    if error is None:
        rows = [] if result is None else result.limit(most).collect()
        out["data"] = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows]
    else:
        out["error"] = {"code": error[0], "message": error[1]}
    return json.dumps(out, default=str)


def run_tool(tool: str, query) -> str:
    """The envelope of query(), or of its failure: invalid arguments, or any other error."""
    try:
        return envelope(tool, query())
    except ValueError as e:
        return envelope(tool, error=("invalid_arguments", str(e)))
    except Exception as e:  # the caller gets every failure as a document
        return envelope(tool, error=("tool_error", str(e)))


def export_path(folder: str, mode: str, focus: str, form: str, name: str | None = None, now: datetime | None = None) -> str:
    """A path below folder: the name with the form's extension, or <utc time>-<mode>-<slug of the focus>."""
    ending = EXTENSIONS[form]
    if not name:
        slug = re.sub(r"[^\w]|_", "-", focus.lower()).strip("-")
        name = f"{(now or datetime.now(timezone.utc)):%Y%m%d-%H%M%S}-{mode}-{slug}"
    return f"{folder.rstrip('/')}/{name if name.endswith(ending) else name + ending}"


def export_text(text: DataFrame, path: str) -> None:
    """Writes the one text of a rendered slice."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(text.first().text)


def workspace_target(names: list[str]) -> str | None:
    """The file that stands for a folder: a .slnx, else a .sln, else a .csproj file, the first by name."""
    for ending in (".slnx", ".sln", ".csproj"):
        own = sorted((n for n in names if n.lower().endswith(ending)), key=str.upper)
        if own:
            return own[0]
    return None
