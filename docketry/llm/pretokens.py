"""Pre-token caches shared by the two tokenisation operators.

Byte-level BPE merges never cross a match of the splitting pattern, so the ids of a text are those of its matches in
turn.  Texts repeat their words: a batch of texts is cut at single spaces, and each different piece (with the space
before it) is looked up once in a bounded cache, or encoded.  A cut at a space leaves all matches as they are unless
white space stands on both sides of the space or ends the text after it; such texts are split by the pattern as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of the younger half of a cache; when it is full it becomes the older half, whose entries go unless they are
#: used again.  That costs time but never changes a result.
CACHE_ENTRIES = 100_000
#: Pieces longer than this are not kept.
CACHE_CHARS = 64
_UNSAFE = re.compile(r"\s \s|\s \Z")
_WINDOW = 1 << 20


class CachedEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``encode_matches`` gets a list of matches of the pattern and returns the bytes of the ids of each.  An encoder that
    splits texts itself gives ``encode_pieces``, which gets any pieces of texts.
    """

    def __init__(self, pattern: str, encode_matches: Callable[[list[str]], list[bytes]], encode_pieces: Callable[[list[str]], list[bytes]] | None = None, entries: int = CACHE_ENTRIES):
        self.pattern, self.encode_matches = regex.compile(pattern), encode_matches
        self.encode_pieces = encode_pieces or self._split_pieces
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> bytes:
        """Ids of a text split by the pattern as a whole, a window of matches at a time."""
        if len(text) <= _WINDOW:
            return b"".join(self._each(self.pattern.findall(text), self.encode_matches))
        out, window, size = [], [], 0
        for m in self.pattern.finditer(text):
            window.append(m.group())
            size += len(window[-1])
            if size >= _WINDOW:
                out += self._each(window, self.encode_matches)
                window, size = [], 0
        out += self._each(window, self.encode_matches)
        return b"".join(out)

    def _each(self, texts: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each text; what the cache lacks is encoded once."""
        ids = list(map(self.young.get, texts))
        if None not in ids:
            return ids
        # The texts may be more than a cache holds, so that what they need is kept apart from it.
        need = dict.fromkeys(t for t, v in zip(texts, ids) if v is None)
        need = {t: self.old.get(t) for t in need}
        missing = [t for t, v in need.items() if v is None]
        if missing:
            need.update(zip(missing, encode(missing)))
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update((t, v) for t, v in need.items() if len(t) <= CACHE_CHARS)
        return [need[t] if v is None else v for t, v in zip(texts, ids)]

    def _split_pieces(self, pieces: list[str]) -> list[bytes]:
        # A space and plain letters are one match; so are most other pieces.
        split = [[p] if p[:1] == " " and p[1:].isalpha() and p.isascii() else self.pattern.findall(p) for p in pieces]
        alone = iter(self.encode_matches([m[0] for m in split if len(m) == 1]))
        several = iter(self._each([x for m in split if len(m) != 1 for x in m], self.encode_matches))
        return [next(alone) if len(m) == 1 else b"".join(next(several) for _ in m) for m in split]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; null and empty ones have none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        listed = column.to_pylist()
        safe = np.array([bool(t) and not _UNSAFE.search(t) for t in listed], bool)
        out = [self.split(t) if t and not s else b"" for t, s in zip(listed, safe)]
        if not safe.any():
            return out
        cut = pc.split_pattern(column.filter(pa.array(safe)), " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        first = np.concatenate([[0], ends[:-1]])
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        pieces = pc.binary_join_element_wise(pa.scalar("", flat.type), coded.dictionary, pa.scalar(" ", flat.type)).to_pylist()
        ids = self._each(pieces, self.encode_pieces)
        # The first piece of a text has no space before it.
        ids += [self.split(p) if p else b"" for p in flat.take(pa.array(first)).to_pylist()]
        at = coded.indices.to_numpy(zero_copy_only=False).copy()
        at[first] = len(pieces) + np.arange(len(first))
        joined = pa.array(ids, pa.large_binary()).take(pa.array(at))
        stops = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        data = memoryview(joined.buffers()[2] or b"")
        for i, a, b in zip(np.flatnonzero(safe).tolist(), stops[first].tolist(), stops[ends].tolist()):
            out[i] = bytes(data[a:b])
        return out
