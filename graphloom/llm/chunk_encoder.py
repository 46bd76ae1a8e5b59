"""Encoding with a byte-level BPE of the tokenizers library, with a cache of words.

The usual byte-level pre-tokenizer always cuts between a non-space and the white space after it, so a text is encoded
in chunks of white space and what follows it up to the next white space. Chunks seen before come from a cache of this
Python worker, of two generations: when the younger is full it becomes the older one, and what is used of that moves
back, so the cache keeps learning within a bounded memory. New chunks go through the library's pre-tokenizer and
model; a chunk of Latin letters is one pre-token by itself.

The cut is sound for that pre-tokenizer only, so the tokenizer file is looked at when it is loaded; with another
normalizer, pre-tokenizer or model, or added tokens that hold or swallow white space, every text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np

_ENCODERS: dict = {}
#: Marks that form a pre-token of their own after a word (no apostrophe: the pre-tokenizer knows contractions).
TAIL = ".,;:!?"
LAST_LATIN = "ɏ"
CACHED_CHARS = 48
#: Chunks in each generation of the cache, some 60 MB when it is full.
CACHED_CHUNKS = 320_000


def cuts_at_white_space(settings: dict) -> bool:
    """settings: of a tokenizers JSON file."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    plain = settings.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    sound = model.get("type") == "BPE" and not model.get("dropout") and settings.get("truncation") is None and settings.get("padding") is None
    own = settings.get("added_tokens") or []
    return bool(plain and sound and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in own))


class ChunkEncoder:
    """path: a tokenizers JSON file. limit: chunks in each of the cache's two generations."""

    def __init__(self, path: str, limit: int = CACHED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self._code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.in_chunks = cuts_at_white_space(settings)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.in_chunks:
            self._added = [t["content"] for t in settings.get("added_tokens") or []]
            self._model, self._pre = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
            letters = [c for c in map(chr, range(ord(LAST_LATIN) + 1)) if c.isalpha()]
            self._as_bytes = {c: self._pre(c)[0][0] for c in letters}
            self._space = self._pre(" a")[0][0][0]
            self._newline, self._tails = self._chunk("\n"), {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, tokens) -> bytes:
        out = array(self._code, [t.id for t in tokens])
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of any chunk, by the library's pre-tokenizer and model."""
        if any(t in chunk for t in self._added):
            return self._library([chunk])[0]
        return b"".join([self._packed(self._model.tokenize(p)) for p, _ in self._pre(chunk)])

    def _new(self, piece: str) -> bytes:
        """piece: a chunk that begins with a newline, or one without the space that it begins with."""
        if piece.isascii() and piece.isalpha():
            return self._packed(self._model.tokenize(self._space + piece))
        after_newline = piece[0] == "\n"
        body = piece.rstrip(TAIL)
        word, tail = body[1:] if after_newline else body, piece[len(body) :]
        if not word.isalpha() or max(word) > LAST_LATIN:
            return self._chunk(piece if after_newline else " " + piece)
        ids = self.young.get(body) or self.old.get(body) if tail else None
        if ids is None:
            own = word if word.isascii() else "".join(map(self._as_bytes.__getitem__, word))
            ids = self._newline + self._packed(self._model.tokenize(own)) if after_newline else self._packed(self._model.tokenize(self._space + own))
            if not tail:
                return ids
            self._keep(body, ids)
        own = self._tails.get(tail)
        if own is None:
            own = self._chunk(tail)
            if len(self._tails) < 1000:
                self._tails[tail] = own
        return ids + own

    def _find(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._new(piece)
        self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= CACHED_CHARS:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[piece] = ids

    def _parts(self, text: str) -> list[bytes]:
        """The ids of each chunk of a text."""
        pieces = text.replace("\n", " \n").split(" ")
        head = pieces[0]
        ids = list(map(self.young.get, pieces))
        ids[0] = self._chunk(head) if head else b""
        missing = [i for i, own in enumerate(ids) if own is None]
        for i in missing:
            piece = pieces[i]
            if not piece or piece[-1].isspace():
                return self._merged(pieces)
            ids[i] = self._find(piece)
        return self._merged(pieces) if head[-1:].isspace() else ids

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """The same where a piece is empty or ends in white space, which then belongs to the chunk after it."""
        out, held = [], ""
        for i, piece in enumerate(pieces):
            if held or not piece or piece[-1].isspace():
                held += piece if not i or piece[:1] == "\n" else " " + piece
                if held and not held[-1].isspace():
                    out.append(self._chunk(held))
                    held = ""
            else:
                out.append(self._find(piece) if i else self._chunk(piece))
        if held:
            out.append(self._chunk(held))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of this encoder's dtype."""
        return [b"".join(self._parts(t)) for t in texts] if self.in_chunks else self._library(texts)

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        own = [sum(map(len, self._parts(t))) for t in texts] if self.in_chunks else map(len, self._library(texts))
        return [n // self.dtype.itemsize for n in own]


def encoder(path: str, limit: int = CACHED_CHUNKS) -> ChunkEncoder:
    """The encoder of this Python process; workers live on between tasks and keep their cache."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = ChunkEncoder(path, limit)
    return _ENCODERS[path, limit]


def in_batches(texts: list[str], most_chars: int = 1 << 20):
    """Index ranges of about most_chars characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
