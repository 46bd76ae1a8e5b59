"""Path functions and predicates; both separators count, case does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments and suffixes that mark files to leave out.
IGNORED_SEGMENTS = (".git", ".idea", ".vs", "bin", "obj", "node_modules")
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyinfo.cs")
GENERATED_SUFFIXES_SHORT = (".g.cs", ".designer.cs", ".generated.cs")
GENERATED_SEGMENTS = ("obj", "bin", "generated")


def normalized(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def segments(path: Column) -> Column:
    return F.split(F.lower(normalized(path)), "/")


def basename(path: Column) -> Column:
    return F.substring_index(normalized(path), "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def relative(path: Column, root: str) -> Column:
    """Below root, or the path itself where it is elsewhere; root must end at a separator."""
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(normalized(path).startswith(head), F.substring(normalized(path), len(head) + 1, 1 << 30)).otherwise(normalized(path))


def has_segment(path: Column, names) -> Column:
    return F.exists(segments(path), lambda s: s.isin(list(names)))


def ignored(path: Column) -> Column:
    return has_segment(path, IGNORED_SEGMENTS)


def generated(path: Column, suffixes=GENERATED_SUFFIXES) -> Column:
    low, out = F.lower(path), has_segment(path, GENERATED_SEGMENTS)
    for s in suffixes:
        out = out | low.endswith(s)
    return out


def generated_short(path: Column) -> Column:
    out = F.lit(False)
    for s in GENERATED_SUFFIXES_SHORT:
        out = out | F.lower(path).endswith(s)
    return out


def test_folder(path: Column) -> Column:
    """A segment test or tests."""
    return has_segment(path, ("test", "tests"))


def test_path(path: Column) -> Column:
    """A segment test or tests, or "test" in the file name. Paths must be relative to the workspace."""
    return test_folder(path) | F.lower(basename(path)).contains("test")


def test_project(name: Column, path: Column) -> Column:
    return F.lower(name).contains("test") | test_folder(path)


def prefixes(path: Column) -> Column:
    """All directories above a path, with no closing separator, the nearest last."""
    parts = F.split(normalized(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
