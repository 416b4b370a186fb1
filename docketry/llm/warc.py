"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payloads are grouped by digest, the record with the largest id of a group is the response and the others
revisit it; each task writes one archive.  Reading: the dictionary is loaded from the first frame of the file, then
each frame is decoded to one record, whose headers, lengths and payload digest are validated.

The dictionary is trained on a bounded sample of payload heads (about ``SAMPLE_ROWS`` rows of ``SAMPLE_CHARS``
characters); it affects sizes only.  Archives of too few rows for a dictionary are written without one.

Defined results: null html is an empty payload; records with a null id have no identity to be revisited by and come
last in the choice of the response; rows that share the largest id of a group of equal payloads are all responses;
an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, read, scratch, stored

SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 32 * 1024
#: Magic of the skippable frame that holds the dictionary, and of a Zstandard frame.
SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def trained_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES``, or nothing if the sample is too small to train one."""
    key, span = F.xxhash64("page_id", "url"), 1 << 40
    bound = int(span * min(1.0, SAMPLE_ROWS / max(pages.count(), 1)))
    # By a hash of their keys, so that each task sends only its share of the sample.
    chosen = pages.where("html is not null").where(F.pmod(key, F.lit(span)) < bound)
    sample = sorted(chosen.select(F.substring("html", 1, SAMPLE_CHARS).alias("head")).collect())[: 2 * SAMPLE_ROWS]
    texts = [row.head.encode() for row in sample if row.head]
    if len(texts) < 16 or sum(map(len, texts)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def header_safe(value: str) -> str:
    return "".join(c if " " < c < "\x7f" else "%" + c.encode().hex("%").upper() for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header only, with the length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {header_safe(url or 'about:blank')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return CRLF.join([*(x.encode() for x in lines), b"", block, b"", b""])


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    head, found, rest = data.partition(CRLF * 2)
    if not found:
        raise ValueError(f"{what}: headers do not end")
    first, *lines = head.decode().split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"{what}: bad header line {line!r}")
        fields[name.lower()] = value.strip()
    return first, fields, rest


def parse(data: bytes) -> dict:
    """Validated fields of one record."""
    version, head, rest = _headers(data, "record")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version!r}")
    kind, length = head["warc-type"], int(head["content-length"])
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind!r}")
    if len(rest) != length + 4 or rest[length:] != CRLF * 2:
        raise ValueError("content length does not match the record")
    status, http, payload = _headers(rest[:length], "http")
    if not status.startswith("HTTP/"):
        raise ValueError("block is not an HTTP response")
    full, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != full:
            raise ValueError("payload length does not match its header")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("payload digest does not match")
    elif payload:
        raise ValueError("a revisit has no payload")
    return {
        "page_id": page_of(head["warc-record-id"]),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload,
    }


def frames(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an open archive, one for each record; memory holds one record and one chunk."""
    data = f.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        raw = f.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    one, out = None, []
    while True:
        if not data:
            data = f.read(chunk)
            if not data:
                break
        if one is None:
            while len(data) < 4:
                more = f.read(chunk)
                if not more:
                    raise ValueError("the archive is cut off")
                data += more
            if struct.unpack("<I", data[:4])[0] != FRAME_MAGIC:
                raise ValueError("not a Zstandard frame")
            one, out = decompressor.decompressobj(), []
        out.append(one.decompress(data))
        data = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(out)
            one = None
    if one is not None:
        raise ValueError("the last record is cut off")


def identified(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): of equal payloads the largest id is the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = groups.where("n > 1").select("digest", "first_id")
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task; returns the manifest (archive, n_records) of the tasks that ended."""
    dictionary = trained_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=data) if data else zstandard.ZstdCompressor(level=3)
        name, out, n = f"pages-{uuid.uuid4().hex}.warc.zst", None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(dictionary_frame(dictionary))
                page_id, url, html, refers_to, revisit = row
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.write(compressor.compress(record(page_id, url, payload, digest, refers_to, revisit)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n_records"])

    with batch_rows(pages.sparkSession, 128):
        return stored(identified(pages).mapInArrow(run, "archive string, n_records long"), "warc-manifest")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives in the manifest; ``payloads`` adds the bytes of responses."""
    schema = SCHEMA + (", payload binary" if payloads else "")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen = [], 0
                with fs.open_input_stream(f"{base}/{archive}") as f:
                    for data in frames(f):
                        parsed = parse(data)
                        rows.append([parsed[k] for k in names])
                        seen += 1
                        if len(rows) >= (64 if payloads else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if seen != n:
                    raise ValueError(f"{archive}: {seen} records, {n} written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder)
