"""Strings, characters and comments of source text, and what brackets enclose, for the texts of an Arrow batch at once.

The texts of a piece of a batch are joined with a NUL between them and go through one scan for strings, characters and comments, whose
places are blanked in one array of code points. Depths of brackets are prefix sums over that array, reset where a text begins, and
brackets are matched by one sort by depth and place, so there is no Python step for each character. A batch is cut into pieces of
about ``PIECE`` characters (a longer text is a piece of its own), which bounds the arrays to some 30 bytes a character.

Edge cases: a null text is empty; NULs within a text count as blanks; a string or comment that doesn't end goes to the end of its line
(quoted) or of its text (raw and verbatim strings, block comments); a bracket without its other half encloses nothing; strings
within the holes of an interpolated string end it, as they did before the language's version 11.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
BLANK = ord(" ")
#: Comments to the end of the line and over lines; raw, verbatim and quoted strings; characters.
LEXEME = re.compile(
    r"//[^\n\0]*+"
    r"|/\*(?:[^*\0]|\*(?!/))*+(?:\*/)?"
    r'|\$*("{3,})(?:(?!\1)[^\0])*+(?:\1"*)?'
    r'|(?:@\$?|\$@)"[^"\0]*+(?:""[^"\0]*+)*+"?'
    r'|\$?"[^"\\\n\0]*+(?:\\[^\n\0][^"\\\n\0]*+)*+"?'
    r"|'(?:\\[^\n\0][^'\n\0]*+|[^'\\\n\0])'"
)


class Lexed:
    """Texts with code as one array: code points, those of strings, characters and comments blank."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes) - 1  # where the NULs stand
        self.starts = self.ends + 1 - sizes
        edges = np.zeros(len(self.points) + 1, np.int32)
        spans = np.array([m.span() for m in LEXEME.finditer(joined)], np.int64).reshape(-1, 2)
        np.add.at(edges, spans[:, 0], 1)
        np.add.at(edges, spans[:, 1], -1)
        self.code = np.where(np.cumsum(edges[:-1]) > 0, np.uint32(BLANK), self.points)

    def text(self, start: int, end: int, points: np.ndarray | None = None) -> str:
        return (self.points if points is None else points)[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def depth(self, opening: str, closing: str) -> np.ndarray:
        """How many of the brackets are open after each place, counted from the start of the place's text."""
        steps = np.isin(self.code, [ord(c) for c in opening]).astype(np.int32) - np.isin(self.code, [ord(c) for c in closing]).astype(np.int32)
        total = np.cumsum(steps)
        before = total[self.starts] - steps[self.starts]
        return total - np.repeat(before, self.ends + 1 - self.starts)

    def pairs(self, opening: str, closing: str) -> tuple[np.ndarray, np.ndarray]:
        """The places of the opening brackets in order, and of what closes each; -1 where nothing does."""
        opens, closes = self.code == ord(opening), self.code == ord(closing)
        places = np.flatnonzero(opens | closes)
        level = self.depth(opening, closing)[places] + closes[places]  # an opening bracket and what closes it have the same
        owner = np.searchsorted(self.ends, places)
        order = np.lexsort((places, level, owner))
        at, kind = places[order], opens[places][order]
        partner = np.full(len(at), -1, np.int64)
        if len(at) > 1:
            same = (level[order][1:] == level[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            fits = same & kind[:-1] & ~kind[1:]
            partner[:-1][fits] = at[1:][fits]
        first, closed = at[kind], partner[kind]
        back = np.argsort(first)
        return first[back], closed[back]


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the list that hold about PIECE characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def enclosed(texts: list[str], froms: list[list[int]], opening: str, closing: str, here: bool = False) -> list[list[str | None]]:
    """For each text and each of its offsets, what the next opening bracket at or after the offset encloses, or the one that stands
    here; None where no bracket opens or closes, or where it is part of a string or comment."""
    out: list[list[str | None]] = []
    for begin, end in pieces(texts):
        if not any(froms[begin:end]):
            out += [[] for _ in range(begin, end)]
            continue
        lexed = Lexed(texts[begin:end])
        first, closed = lexed.pairs(opening, closing)
        for i, start in enumerate(lexed.starts):
            own = []
            for offset in froms[begin + i]:
                at = int(np.searchsorted(first, start + offset))
                found = at < len(first) and first[at] < lexed.ends[i] and closed[at] >= 0 and not (here and first[at] != start + offset)
                own.append(lexed.text(first[at] + 1, closed[at]) if found else None)
            out.append(own)
    return out


_MODIFIERS = re.compile(r"^(?:(?:this|in|out|ref|params|scoped|readonly)\s+)+")
_TYPED = re.compile(r"(.+?)\s+@?[A-Za-z_]\w*$", re.S)


def parameter_types(texts: list[str]) -> list[list[str]]:
    """Types of each parameter list: split at commas outside brackets; comments, attributes, modifiers, names and defaults go."""
    out: list[list[str]] = []
    for begin, end in pieces(texts):
        lexed = Lexed(texts[begin:end])
        depth = lexed.depth("<([{", ">)]}")
        commas = np.flatnonzero((lexed.code == ord(",")) & (depth == 0))
        equals = np.flatnonzero((lexed.code == ord("=")) & (depth == 0))
        opens, closes = lexed.pairs("[", "]")
        closing = dict(zip(opens.tolist(), closes.tolist()))
        for start, stop in zip(lexed.starts, lexed.ends):
            cuts = [start - 1, *commas[np.searchsorted(commas, start) : np.searchsorted(commas, stop)], stop]
            types = []
            for left, right in zip(cuts[:-1], cuts[1:]):
                default = int(np.searchsorted(equals, left))
                right = equals[default] if default < len(equals) and equals[default] < right else right
                at = left + 1
                while at < right and (lexed.code[at] in (9, 10, 13, BLANK) or closing.get(int(at), -1) >= 0):
                    at = closing.get(int(at), int(at)) + 1
                m = _TYPED.match(_MODIFIERS.sub("", lexed.text(at, right, lexed.code).strip()))
                if m:
                    types.append(re.sub(r"\s+", "", m.group(1).replace("global::", "")).rstrip("?"))
            out.append(types)
    return out
