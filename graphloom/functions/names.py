"""Name functions: identifiers, containers, type names, text clean-up. Comparisons that ignore case fold character by character."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upper_of(c: str) -> str:
    """The one character that stands for c in comparisons that ignore case: its upper case, where that is one character and,
    for a character beyond ASCII, not an ASCII one."""
    for other in (c.upper(), c.title()):
        if len(other) == 1:
            return c if other.isascii() and not c.isascii() else other
    return c


_FOLDS = {c: _upper_of(c) for c in map(chr, range(sys.maxunicode + 1)) if c.lower() != c.upper() and _upper_of(c) != c}
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())
_TABLE = str.maketrans(_FOLDS)


def fold_text(x: str) -> str:
    """The same as fold_ci, of a Python string."""
    return x.translate(_TABLE)


def fold_ci(x: Column | str) -> Column:
    """A text (or the column of that name) with each character in place of all that differ from it in case only.

    Unlike upper(), no character becomes two, so "ß" isn't "SS". Pure ASCII texts take the faster of two equal ways.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.octet_length(x) == F.char_length(x), F.upper(x)).otherwise(F.translate(x, _FROM, _TO))


def blank(x: Column) -> Column:
    """Null or white space only."""
    return F.coalesce(F.trim(x), F.lit("")) == ""


def equals_ci(a: Column, b: Column) -> Column:
    return fold_ci(a) == fold_ci(b)


def contains_ci(a: Column, b: Column) -> Column:
    return fold_ci(a).contains(fold_ci(b))


def ends_with_ci(a: Column, b: Column) -> Column:
    return fold_ci(a).endswith(fold_ci(b))


def trailing_identifier(x: Column) -> Column:
    """The part before "(" and after the last "."; a name that ends in "." stays whole."""
    bare = F.substring_index(x, "(", 1)
    return F.when(bare.endswith("."), bare).otherwise(F.substring_index(bare, ".", -1))


def container_prefix(x: Column) -> Column:
    """The part before the last ".", or null."""
    out = F.regexp_extract(x, r"^(.+)\.[^.]*$", 1)
    return F.when(out != "", out)


def after_colon(x: Column) -> Column:
    """The text after the first ":", or all of it."""
    out = F.regexp_extract(x, r"^[^:]*:(.+)$", 1)
    return F.when(out != "", out).otherwise(x)


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def type_name(x: Column) -> Column:
    """Without "global::" and trailing "?"."""
    return F.regexp_replace(F.trim(F.replace(x, F.lit("global::"), F.lit(""))), r"\?+$", "")


def simple_type_name(x: Column) -> Column:
    return F.substring_index(type_name(x), ".", -1)


def strip_comment(x: Column) -> Column:
    return F.substring_index(x, "//", 1)


def slug(x: Column) -> Column:
    """Lower case; each character that is neither letter nor digit a hyphen; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def escape_mermaid(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit(" "))


def escape_dot(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def line_of_offset(content: Column, before: Column) -> Column:
    """The 1-based line of the character after the first `before` characters."""
    head = F.substring(content, F.lit(1), before)
    return (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def pack(*parts: Column) -> Column:
    """Texts joined by "|"; a "|" within one is escaped."""
    return F.concat_ws("|", *[F.replace(F.replace(p, F.lit("\\"), F.lit("\\s")), F.lit("|"), F.lit("\\p")) for p in parts])


def unpack(x: Column) -> Column:
    """The texts that were packed."""
    return F.transform(F.split(x, r"\|"), lambda p: F.replace(F.replace(p, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\")))
