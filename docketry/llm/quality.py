"""Quality by compression: two Zstandard dictionaries, one of good and one of bad text.

A text is compressed, in pieces of ``PIECE_BYTES`` so that the dictionaries matter all along it, once with the
dictionary built from text labelled good and once with that of text labelled bad.  The normalised difference

    (bad size - good size) / (bad size + good size)

says which kind of text it is like; the share of its bytes that the better dictionary leaves tells repetition, which
both compress to nothing.  A logistic calibration on labelled rows that no dictionary was built from turns the two into
the probability of label 1.

Training is on a bounded sample of the training fold (crc32 of the id as text, modulo 5, is not 0): at most ``MAX_ROWS``
ids of each label, the first by a hash; half of them give the dictionaries at most ``TEXT_PIECES`` pieces each, from
anywhere in the text, and about ``MAX_PIECES`` different pieces for each label; the other half calibrates.  Scoring is
on every whole text.  Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of a difference of 0 and a share of 1; a null ``doc_id`` counts as the
empty string for the fold; labels that repeat an id count as good if one of them is; if a label has no rows to learn from,
all texts get the share of good rows in the training fold, or 0.5 if it has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, dropped, read, small_batches, stored, text_slices
from docketry.llm.shingles import string_buffers

PIECE_BYTES, DICTIONARY_BYTES, LEVEL = 2048, 112_640, 3
MAX_ROWS, MAX_PIECES, TEXT_PIECES = 4000, 6000, 8
#: A dictionary is trained if there are so many pieces; fewer are joined to one as they are.
MIN_PIECES = 32
STEPS, PENALTY, THRESHOLD = 50, 1e-3, 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary built from the pieces; empty if there are none."""
    if len(pieces) >= MIN_PIECES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too little or too uniform text for training
    return b"".join(pieces)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes under the dictionaries of bad and good text."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.compressors = []
        for content in (bad, good):
            d = zstandard.ZstdCompressionDict(content)  # content without a dictionary's header is used as it is
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, **options))

    def measures(self, column: pa.Array) -> np.ndarray:
        """[text, (difference, share)] of a string array."""
        raw, off = string_buffers(column)
        view, out = memoryview(raw), np.zeros((len(column), 2))
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            bad = good = 0
            for at in range(a, b, PIECE_BYTES):
                piece = view[at : min(at + PIECE_BYTES, b)]
                bad += len(self.compressors[0].compress(piece))
                good += len(self.compressors[1].compress(piece))
            out[i] = ((bad - good) / (bad + good), min(bad, good) / (b - a)) if b > a else (0.0, 1.0)
        return out


@dataclass
class Classifier:
    """Dictionaries and calibration; without dictionaries the score is ``prior`` throughout."""

    bad: bytes
    good: bytes
    weights: np.ndarray
    prior: float

    def scorer(self):
        """A function from a string array to scores."""
        if not self.bad or not self.good:
            return lambda column: np.full(len(column), self.prior)
        sizes = Sizes(self.bad, self.good)
        return lambda column: probability(sizes.measures(column), self.weights)


def _inputs(measures: np.ndarray) -> np.ndarray:
    # Shares above 1 are the frames of very short texts and say nothing more.
    return np.column_stack([np.ones(len(measures)), 10 * measures[:, 0], 5 * np.minimum(measures[:, 1], 1.0)])


def probability(measures: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(_inputs(measures) @ weights, -30, 30)))


def calibrated(measures: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton's steps."""
    x, w = _inputs(measures), np.zeros(3)
    for _ in range(STEPS):
        p = probability(measures, w)
        slope = x.T @ (p - good) / len(good) + PENALTY * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(good) + PENALTY * np.eye(3)
        w = w - np.linalg.solve(curve, slope)
    return w


def _pieces(docs: DataFrame) -> DataFrame:
    """Different (good, piece) of (doc_id, good, text); which pieces of a long text is a choice seeded by its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                raw, off = string_buffers(batch.column(1))
                good, found = [], []
                for g, i, j in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    places = np.arange(i, j, PIECE_BYTES)
                    if len(places) > TEXT_PIECES:
                        places = np.sort(np.random.default_rng(j - i).permutation(places)[:TEXT_PIECES])
                    good += [g] * len(places)
                    found += [raw[at : min(at + PIECE_BYTES, j)].tobytes() for at in places.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(found, pa.binary())], ["good", "piece"])

    return docs.select("good", "text").mapInArrow(cut, "good int, piece binary").dropDuplicates(["good", "piece"])


def _built(pieces: DataFrame, good: int) -> bytes:
    """The dictionary of one label from about ``MAX_PIECES`` pieces, the first by a hash of their bytes."""
    mine, span = pieces.where(F.col("good") == good).select("piece"), 1 << 40
    bound = int(span * min(1.0, (MAX_PIECES + 4 * math.sqrt(MAX_PIECES)) / max(mine.count(), 1)))
    chosen = mine.where(F.pmod(F.xxhash64("piece"), F.lit(span)) < bound).collect()
    return dictionary(sorted(bytes(r.piece) for r in chosen))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    marked = marked.where(~held_out(F.col("doc_id")))
    share = marked.agg(F.avg("good")).first()[0]
    prior = 0.5 if share is None else float(share)
    order = F.xxhash64(F.lit("quality"), "doc_id")
    sides = [marked.where(F.col("good") == g).orderBy(order, "doc_id").limit(MAX_ROWS) for g in (0, 1)]
    calibrates = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(2)) == 1
    # Bounded: at most 2 * MAX_ROWS ids.
    chosen = stored(sides[0].unionByName(sides[1]).withColumn("calibrates", calibrates), "quality-ids")
    own = docs.select(F.col("doc_id"), F.col("text"))
    texts = own.join(F.broadcast(chosen), "doc_id")
    with batch_rows(spark):
        pieces = stored(_pieces(texts.where("not calibrates")), "quality-pieces")
    bad, good = _built(pieces, 0), _built(pieces, 1)
    dropped(pieces)
    nothing = Classifier(b"", b"", np.zeros(3), prior)
    if not bad or not good:
        dropped(chosen)
        return nothing

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bad, good)
        for whole in batches:
            for a, b in text_slices(whole.column(2)):
                batch = whole.slice(a, b - a)
                m = sizes.measures(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m[:, 0]), pa.array(m[:, 1])], ["doc_id", "good", "difference", "share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with batch_rows(spark):
        rows = texts.where("calibrates").select("doc_id", "good", "text").mapInArrow(measured, f"doc_id {kind}, good int, difference double, share double")
        rows = rows.groupBy("doc_id", "good").agg(F.min(F.struct("difference", "share")).alias("m")).orderBy("doc_id").collect()  # one for each chosen id
    dropped(chosen)
    measures, y = np.array([[r.m.difference, r.m.share] for r in rows]).reshape(-1, 2), np.array([r.good for r in rows], float)
    if len(set(y.tolist())) < 2:
        return nothing
    return Classifier(bad, good, calibrated(measures, y), prior)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for whole in batches:
            for a, b in text_slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    small_batches(spark)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by the dictionaries of good and bad text."""
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
