"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The tokens of a pre-token are a doubly linked list of byte positions.  Each adjacent pair with a rank waits in the
bucket of that rank; a three-level bitmap over ranks gives the lowest occupied bucket by find-first-set, so that
the next merge costs the same however long the pre-token is.  Entries whose pair has changed are stale and skipped.
Within a bucket the leftmost position goes first, as the order of merges demands.  Many pre-tokens wait in one queue,
since merges of one do not touch another: a bucket is found once for all of them.

Defined results: null and empty texts have no ids and decode to empty bytes; special tokens are ordinary text.
Other columns of the table, whatever their names, are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import give_back, read, small_batches, text_slices
from docketry.llm.pretokens import CachedEncoder


#: Bytes of texts whose different pieces are encoded together.
ENCODED_BYTES = 4 << 20
#: Bytes of matches that wait in one queue together (a longer match is alone).
QUEUED_BYTES = 512 << 10
#: Positions of a bucket from which on they are merged at once.
AT_ONCE = 24


class RankQueue:
    """A set of ranks with the positions that wait under each; the lowest rank is found in three steps."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.add(rank, [position])

    def add(self, rank: int, positions: list[int]) -> None:
        """Ascending positions for a rank under which nothing waits."""
        self.buckets[rank] = positions
        word = rank >> 6
        if not self.low[word]:
            group = word >> 6
            if not self.mid[group]:
                self.top |= 1 << group
            self.mid[group] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def lowest(self) -> int:
        """Lowest rank; the queue must not be empty (``top`` is 0 then)."""
        top = self.top
        group = (top & -top).bit_length() - 1
        mid = self.mid[group]
        word = (group << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        return (word << 6) + (low & -low).bit_length() - 1

    def remove(self, rank: int) -> None:
        """Take away a rank under which nothing waits any more."""
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            group = word >> 6
            self.mid[group] ^= 1 << (word & 63)
            if not self.mid[group]:
                self.top ^= 1 << group


class BytePairEncoding:
    """Ranks of byte strings, and the merges that they define."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        #: Stand for the gap between matches and for a byte that is no token.
        self.gap, self.unknown = len(self.vocabulary), len(self.vocabulary) + 1
        self.single = np.array([ranks.get(bytes([i]), self.unknown) for i in range(256)], np.int32)
        # Ranks of all pairs of tokens that make a token, and the tokens that are part of one with a lower rank.
        keys, merged, self.early = [], [], set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
                    self.early.update(r for r in (left, right) if r > rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[order], -1)
        self.cached = CachedEncoder(pattern, lambda matches: self.encode_matches([m.encode() for m in matches]))

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoding:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def encode_match(self, piece: bytes) -> bytes:
        """Ids (uint32, little-endian) of one match of the pattern."""
        return self.encode_matches([piece])[0]

    def encode_matches(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match; those that are no token as a whole are merged together, some bytes at a time."""
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in map(self.ranks.get, pieces)]
        group, size = [], 0
        for i, ids in enumerate(out):
            if ids or not pieces[i]:
                continue
            if group and size + len(pieces[i]) > QUEUED_BYTES:
                self._merge(pieces, group, out)
                group, size = [], 0
            group.append(i)
            size += len(pieces[i])
        if group:
            self._merge(pieces, group, out)
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.merged[at], np.int32(-1))

    def _merge(self, pieces: list[bytes], group: list[int], out: list[bytes]) -> None:
        """Set ``out`` for the pieces of ``group``.

        All wait in one queue, with a gap before and after each, so that no pair crosses: the merges of a piece come in
        the order in which they would come alone.  A large bucket is merged at once, unless two of its merges share a
        token or one may give a pair of a lower rank.
        """
        data = b"\0" + b"\0".join([pieces[i] for i in group]) + b"\0"
        n = len(data)
        gaps = np.cumsum([0, *(len(pieces[i]) + 1 for i in group)])
        # Each list once for numpy and once, with the same memory, for single positions.
        tokens, after, before = self.single[np.frombuffer(data, np.uint8)], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        tokens[gaps] = self.gap
        pairs, inside = np.full(n, -1, np.int32), np.zeros(n, np.uint8)
        pairs[:-1] = self._ranks_of(tokens[:-1], tokens[1:])
        token, follows, precedes, pair, hidden = map(memoryview, (tokens, after, before, pairs, inside))
        ranks, gap, early, queue = self.ranks, self.gap, self.early, RankQueue(len(self.vocabulary))
        waiting = np.flatnonzero(pairs >= 0)
        waiting = waiting[np.argsort(pairs[waiting], kind="stable")]
        lowest, starts = np.unique(pairs[waiting], return_index=True)
        for rank, positions in zip(lowest.tolist(), np.split(waiting, starts[1:])):
            queue.add(rank, positions.tolist())
        buckets, push = queue.buckets, queue.push
        while queue.top:
            rank = queue.lowest()
            bucket = buckets[rank]
            if len(bucket) >= AT_ONCE and rank not in early:
                at = np.unique(np.array(bucket, np.int32))
                at = at[pairs[at] == rank]
                second = after[at]
                if not (second[:-1] == at[1:]).any():
                    queue.remove(rank)
                    end = after[second]
                    after[at], before[end], tokens[at] = end, at, rank
                    inside[second], pairs[second] = 1, -1
                    left, same = before[at], tokens[at]
                    found = self._ranks_of(np.concatenate([same, tokens[left]]), np.concatenate([tokens[end], same]))
                    both = np.concatenate([at, left])
                    pairs[both] = found
                    held = found >= 0
                    for r, i in zip(found[held].tolist(), both[held].tolist()):
                        if waits := buckets.get(r):
                            heappush(waits, i)
                        else:
                            push(r, i)
                    continue
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue
                j = follows[i]
                follows[i] = end = follows[j]
                precedes[end] = i
                token[i] = least = rank
                hidden[j] = 1
                pair[i] = pair[j] = -1
                if token[end] != gap:
                    found = ranks.get(data[i : follows[end]])
                    if found is not None:
                        pair[i] = found
                        push(found, i)
                        least = min(least, found)
                left = precedes[i]
                if token[left] != gap:
                    found = ranks.get(data[left:end])
                    pair[left] = -1 if found is None else found
                    if found is not None:
                        push(found, left)
                        least = min(least, found)
                if least < rank:
                    break
            if not bucket:
                queue.remove(rank)
        inside[gaps] = 1
        begins = np.flatnonzero(inside == 0)
        ids = tokens[begins]
        if (ids == self.unknown).any():
            at = int(begins[np.argmax(ids == self.unknown)])
            raise KeyError(data[at : at + 1])
        ids = ids.astype("<u4").tobytes()
        stops = (4 * np.searchsorted(begins, gaps)).tolist()
        for i, a, b in zip(group, stops, stops[1:]):
            out[i] = ids[a:b]

    def encode(self, text: str | None) -> bytes:
        return self.cached.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], BytePairEncoding] = {}


def loaded(path: str, pattern: str) -> BytePairEncoding:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairEncoding.from_file(path, pattern)
    return _LOADED[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary): the ids of each whole text and the bytes that they decode to."""
    return _per_text(
        docs, path, pattern, "doc_id long, ids binary, decoded binary", lambda bpe, ids: (ids, bpe.decode(ids)), [pa.binary(), pa.binary()]
    )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    return _per_text(
        docs,
        path,
        pattern,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda bpe, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()),
        [pa.int64(), pa.string(), pa.string()],
    )


def _per_text(docs: DataFrame, path: str, pattern: str, schema: str, result, types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers come from earlier steps and stay for later ones.
        give_back()
        bpe = loaded(path, pattern)
        for whole in batches:
            for a, b in text_slices(whole.column(1), ENCODED_BYTES):
                batch = whole.slice(a, b - a)
                rows = [result(bpe, ids) for ids in bpe.cached.encode_many(batch.column(1))]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], [f.split()[0] for f in schema.split(", ")])
            give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def vocabulary_path() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), *vocabulary_path())
