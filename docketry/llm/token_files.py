"""Token ids in length-delimited binary shards with masked checksums and a separate offset index.

A shard is a sequence of records.  Record: length of the payload (uint64), masked checksum of those eight bytes
(uint32), payload, masked checksum of the payload (uint32), all little-endian.  The checksum is CRC-32, masked by a
rotation to the right by 15 bits and the addition of 0xA282EAD8, so that checksums of data that hold checksums stay
useful.  Payload: flags (uint8; 1: the id is null, 2: ids have four bytes), doc_id (int64), token ids (uint16 or
uint32).  The index beside it holds the offset and the length of every record (two uint64), so that records can be
read in any order.

Documents are dealt by ranges of ``doc_id``, sorted within a range, and each task writes its own shard under a name
of its own attempt; only shards of the manifest count, so that retried tasks leave no double rows.

Defined results: null text counts as empty (only the end id); a null ``doc_id`` comes first; rows that repeat an id
follow each other ordered by text; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import gathered, read, scratch, small_batches, stored, text_slices
from docketry.llm.pretokens import CachedEncoder

END_ID = 0
MASK_DELTA = 0xA282EAD8
_LENGTH, _SUM, _HEAD, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQ")
#: The end id as it is appended to the ids of a text.
END = _SUM.pack(END_ID)
#: Pieces that are encoded as one text.
JOINED = 2_000
#: Bytes of texts whose different pieces are encoded together.
ENCODED_BYTES = 8 << 20
#: Entries of the younger half of the cache of pieces.
CACHE_ENTRIES = 400_000
FRAME = _LENGTH.size + 2 * _SUM.size


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """Payload of the record at ``at`` and the offset after it; ValueError if a length or checksum is wrong."""
    length = data[at : at + 8]
    if len(length) < 8 or _SUM.unpack_from(data, at + 8)[0] != masked(length):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + _LENGTH.unpack(length)[0]
    payload = data[at + 12 : end]
    if end + 4 > len(data) or _SUM.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload, end + 4


def index_entry(offset: int, length: int) -> bytes:
    return _ENTRY.pack(offset, length)


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    head = _HEAD.pack((doc_id is None) | (2 * wide), doc_id or 0)
    return head + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_HEAD.size)
    return (None if flags & 1 else doc_id), ids


class LibraryEncoder:
    """The tokenizers library behind a cache of pre-tokens."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = CachedEncoder(PATTERN, self._ids, self._ids_of_pieces, CACHE_ENTRIES)
        # Tokens are written in an alphabet of 256 characters that stand for bytes.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  Pieces that begin with their only outer white space, a space, are encoded as one text.

        No match of the pattern crosses from one to the next, so that the bytes of tokens show where each ends.
        """
        plain = [p[:1] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() for p in pieces]
        together = [p for p, x in zip(pieces, plain) if x]
        joined = ["".join(together[i : i + JOINED]) for i in range(0, len(together), JOINED)]
        if any(s in text for s in self.special for text in joined):
            return self._ids(pieces)
        ids = np.frombuffer(b"".join(self._ids(joined)), "<u4")
        ends = np.cumsum([len(p.encode()) for p in together])
        token_ends = np.cumsum(self.sizes[ids])
        at = np.searchsorted(token_ends, ends) + 1
        if len(ends) and (token_ends[-1] != ends[-1] or (token_ends[at - 1] != ends).any()):
            return self._ids(pieces)
        data, stops = ids.tobytes(), (4 * at).tolist()
        whole = (data[a:b] for a, b in zip([0, *stops], stops))
        others = iter(self._ids([p for p, x in zip(pieces, plain) if not x]))
        return [next(whole) if x else next(others) for x in plain]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last.  Texts that hold a special token's string are not cut."""
        special = [bool(t) and any(s in t for s in self.special) for t in texts]
        ids = self.cached.encode_many([None if s else t for s, t in zip(special, texts)])
        ids = [self._ids([t])[0] if s else i for s, t, i in zip(special, texts, ids)]
        return [np.frombuffer(i + END, "<u4") for i in ids]


_LOADED: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def write_shards(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encode and write; returns the manifest (part, shard, n_docs, n_ids), parts in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, n_docs, n_ids, offset = loaded(tokenizer), None, 0, 0, 0
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, base = pafs.FileSystem.from_uri(folder)
        for whole in gathered(batches, ENCODED_BYTES):
            for a, b in text_slices(whole.column(1), ENCODED_BYTES):
                batch = whole.slice(a, b - a)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, index = fs.open_output_stream(f"{base}/{name}.bin"), fs.open_output_stream(f"{base}/{name}.idx")
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist())):
                    record = frame(pack(doc_id, ids))
                    out.write(record)
                    index.write(index_entry(offset, len(record)))
                    offset += len(record)
                    n_docs += 1
                    n_ids += len(ids)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "shard", "n_docs", "n_ids"])

    small_batches(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return stored(dealt.mapInArrow(run, "part long, shard string, n_docs long, n_ids long"), "token-manifest")


def records(fs: pafs.FileSystem, base: str, shard: str, chunk: int = 64) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a shard in order, read a few at a time by its index."""
    with fs.open_input_stream(f"{base}/{shard}.idx") as f:
        entries = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(f"{base}/{shard}.bin") as f:
        for i in range(0, len(entries), chunk):
            group = entries[i : i + chunk]
            data, at = f.read_at(int(group[:, 1].sum()), int(group[0, 0])), 0
            for _ in range(len(group)):
                payload, at = unframe(data, at)
                yield unpack(payload)


def record_at(fs: pafs.FileSystem, base: str, shard: str, position: int) -> tuple[int | None, np.ndarray]:
    """One record by its position, for shuffled reads."""
    with fs.open_input_file(f"{base}/{shard}.idx") as f:
        offset, length = _ENTRY.unpack(f.read_at(_ENTRY.size, position * _ENTRY.size))
    with fs.open_input_file(f"{base}/{shard}.bin") as f:
        return unpack(unframe(f.read_at(length, offset))[0])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the shards in the manifest, checked on the way.

    The running start of shards is a window over one row per shard.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"), "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["base"], []
                for doc_id, ids in records(fs, base, row["shard"]):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if len(rows) != row["n_docs"]:
                    raise ValueError(f"{row['shard']}: {len(rows)} records, {row['n_docs']} written")
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-shards")
    manifest = write_shards(read(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_shards(manifest, folder)
