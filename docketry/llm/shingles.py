"""Vectorised word and shingle hashing over Arrow string buffers.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are folded to lower case.  All work is
numpy over whole Arrow batches: no Python loop runs per word.  Hashes are 64 bits and depend on the bytes alone,
so every executor, run and partitioning gives the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_WINDOW = 1 << 16


def _inverse_powers() -> tuple[np.ndarray, np.ndarray]:
    inv = pow(int(_MULT), -1, 1 << 64)
    up = np.full(_WINDOW, _MULT, _U)
    down = np.full(_WINDOW, _U(inv), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


_POW, _INV = _inverse_powers()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 (wrapping arithmetic)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte; A-Z have those of a-z.
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _MULT)[_LOWER]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string array; nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind, n + 1, at * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw, off = raw[off[0] : off[-1]], off - off[0]
    if column.null_count and (np.diff(off)[~np.asarray(column.is_valid())]).any():
        return string_buffers(column.fill_null(""))
    return raw, off


#: Bytes that end a plain word: all of ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words_of(raw: np.ndarray, off: np.ndarray, ends_word: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it belongs to, in order."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = ends_word[raw]
    begin = ~gap[1:-1] & gap[:-2]
    first = off[:-1][np.diff(off) > 0]
    begin[first] |= ~gap[1:-1][first]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    if len(ends) != len(starts):  # rows that touch without white space
        close = ~gap[1:-1] & gap[2:]
        last = off[1:][np.diff(off) > 0] - 1
        close[last] |= ~gap[1:-1][last]
        ends = np.flatnonzero(close) + 1
    rows = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in random byte values, taken from prefix sums, then mixed."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    value = _BYTE[raw]
    sums = np.zeros(len(raw) + 1, _U)
    for i in range(0, len(raw), _WINDOW):  # powers begin anew in each window
        part = value[i : i + _WINDOW]
        np.multiply(part, _POW[: len(part)], out=sums[i + 1 : i + 1 + len(part)])
    np.cumsum(sums, out=sums)
    same = starts // _WINDOW == (ends - 1) // _WINDOW
    s, e = starts[same], ends[same]
    out[same] = (sums[e] - sums[s]) * _INV[s % _WINDOW]
    for i in np.flatnonzero(~same):  # the few words that cross a window of powers
        s, e = int(starts[i]), int(ends[i])
        v, acc, scale = value[s:e], _U(0), _U(1)
        for k in range(0, e - s, _WINDOW):
            part = v[k : k + _WINDOW]
            acc = acc + scale * (part * _POW[: len(part)]).sum(dtype=_U)
            scale = scale * _POW[-1] * _MULT
        out[i] = acc
    return mix64(out + (ends - starts).astype(_U) * _MULT)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (hashes sorted within a row, offsets of n + 1 rows).

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    raw, off = string_buffers(column)
    n = len(off) - 1
    with np.errstate(over="ignore"):
        starts, ends, rows = words_of(raw, off)
        h = word_hashes(raw, starts, ends)
        count = np.bincount(rows, minlength=n)
        base = np.concatenate(([0], np.cumsum(count)))
        full = len(h) - width + 1
        pieces_h, pieces_r = [], []
        if full > 0:
            acc = np.full(full, _U(width), _U)
            for k in range(width):
                acc *= _MULT
                acc += mix64(h[k : k + full] + _U(k + 1))
            ok = rows[:full] == rows[width - 1 :]
            pieces_h.append(mix64(acc[ok]))
            pieces_r.append(rows[:full][ok])
        for words in range(1, width):
            short = np.flatnonzero(count == words)
            if len(short):
                at = base[short]
                acc = np.full(len(short), _U(words), _U)
                for k in range(words):
                    acc = acc * _MULT + mix64(h[at + k] + _U(k + 1))
                pieces_h.append(mix64(acc))
                pieces_r.append(short)
        if not pieces_h:
            return np.zeros(0, _U), np.zeros(n + 1, np.int64)
        hashes, owner = np.concatenate(pieces_h), np.concatenate(pieces_r)
    # Rows of width words or more come first and in order, so that few rows are moved here.
    if len(pieces_h) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    hashes = sorted_within(hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))))
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int64)


def sorted_within(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``values`` with each row's sorted, in place: rows are short, so that this is faster than one sort by two keys."""
    ends = offsets.tolist()
    for i, j in zip(ends[:-1], ends[1:]):
        if j - i > 1:
            values[i:j].sort()
    return values
