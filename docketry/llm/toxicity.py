"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the other side is text whose label is not looked at.  With the class prior
``pi`` of the training fold, linear classifiers on hashed words minimise the non-negative risk

    pi * E_P[loss(f)] + max(0, E_U[loss(-f)] - pi * E_P[loss(-f)])

with the logistic loss, so that ``f`` estimates the log odds of the label.  Where the second term turns negative
the step goes back along it, as the estimator demands.

Training is on a bounded sample of the training fold (crc32 of the id as text, modulo 3, is not 1): at most
``MAX_POSITIVE`` toxic rows of ``labels`` and about ``MAX_UNLABELLED`` of all documents, the first by a hash of their
ids.  Features are counted and screened in the executors, so that the driver gets those that matter, not texts.
Scoring is on every whole text.  Neither labels nor language, source or id are inputs of a score.

Defined results: null and empty texts get the score of a text without words; a null ``doc_id`` counts as the empty
string for the fold; labels that repeat an id count as toxic if one of them is; without any positive the score is
the prior, 0 if there are no labels at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, dropped, read, small_batches, stored, text_slices
from docketry.llm.shingles import NOT_ALNUM, string_buffers, word_hashes, words_of

MAX_POSITIVE, MAX_UNLABELLED = 2500, 5000
#: Bytes of the word beginnings that are features beside whole words, so that inflected forms share weight.
PREFIXES = (4, 5, 6)
#: A feature has weight only if it is in this many positives and its shares in positives and unlabelled text differ so
#: many standard errors; millions of features are screened.
MIN_TEXTS, MIN_Z = 8, 7.0
MODELS, STEPS, RATE, PENALTY = 3, 200, 0.1, 1e-4
THRESHOLD = 0.7
#: Bits of the table that tells most words without weight from the rest before the exact search.
TABLE_BITS = 22


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, 64-bit features) of a string array: its whole plain words, then their beginnings of each length."""
    raw, off = string_buffers(column)
    with np.errstate(over="ignore"):
        starts, ends, rows = words_of(raw, off, NOT_ALNUM)
        yield rows, word_hashes(raw, starts, ends)
        for n in PREFIXES:
            longer = ends - starts > n
            at = starts[longer]
            yield rows[longer], word_hashes(raw, at, at + n) ^ np.uint64(n)


@dataclass
class Linear:
    """Sorted features that matter, their weights, and the log odds of a text without any of them."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.features >> np.uint64(64 - TABLE_BITS)] = True

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(self.features)
        pairs = [np.zeros(0, np.int64)]
        if n:
            for rows, found in features_of(column):
                some = self.table[found >> np.uint64(64 - TABLE_BITS)]
                rows, found = rows[some], found[some]
                at = np.minimum(np.searchsorted(self.features, found), n - 1)
                exact = self.features[at] == found
                pairs.append(rows[exact] * n + at[exact])
        pairs = np.unique(np.concatenate(pairs))
        total = np.bincount(pairs // max(n, 1), self.weights[pairs % max(n, 1)] if n else None, minlength=len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(total[: len(column)] + self.bias, -30, 30)))


def fit_one(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float, n_cols: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; ``rows``/``cols`` are the set entries of a binary matrix."""
    n = len(positive)
    p, u = positive, ~positive
    w, b = np.zeros(n_cols), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(n_cols + 1), np.zeros(n_cols + 1), 0
    for t in range(1, STEPS + 1):
        f = np.bincount(rows, w[cols], minlength=n) + b
        s = 1.0 / (1.0 + np.exp(-np.clip(f, -30, 30)))
        negative_loss = np.logaddexp(0, f)  # loss(-f)
        rest = negative_loss[u].mean() - prior * negative_loss[p].mean()
        slope = np.zeros(n)
        if rest >= 0:
            slope[p] = (prior * (s[p] - 1) - prior * s[p]) / p.sum()
            slope[u] = s[u] / u.sum()
        else:
            slope[p] = prior * s[p] / p.sum()
            slope[u] = -s[u] / u.sum()
        grad = np.append(np.bincount(cols, slope[rows], minlength=n_cols) + PENALTY * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def screened(sample: DataFrame, n_positive: int, n_other: int) -> np.ndarray:
    """Sorted features whose shares in positives and in unlabelled texts of ``sample`` differ beyond chance."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [], []
            for positive, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sides[not positive].append(np.frombuffer(words, "<u8"))
            for side, texts in enumerate(sides):
                found, n = np.unique(np.concatenate([np.zeros(0, "<u8"), *texts]), return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(none if side else n), pa.array(n if side else none)], ["feature", "inside", "outside"])

    counts = sample.mapInArrow(counted, "feature long, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    p = (F.col("inside") + F.col("outside")) / float(n_positive + n_other)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n_positive + 1 / n_other))
    matter = F.abs(F.col("inside") / float(n_positive) - F.col("outside") / float(n_other)) / error >= MIN_Z
    found = counts.where((F.col("inside") >= MIN_TEXTS) & matter).select("feature").collect()  # at most MAX_POSITIVE / MIN_TEXTS times a text's words
    return np.sort(np.array([r.feature for r in found], np.int64).view(np.uint64))


def fit(known: np.ndarray, rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float) -> Linear:
    """Average of ``MODELS`` classifiers, each on its own share of positives and unlabelled texts."""
    prior = float(np.clip(prior, 1e-3, 0.9))
    share = np.zeros(len(positive), int)
    for side in (positive, ~positive):
        share[side] = np.arange(side.sum()) % MODELS
    weights, bias, n_fit = np.zeros(len(known)), 0.0, 0
    for k in range(MODELS):
        mine = share == k
        if not positive[mine].any() or positive[mine].all():
            continue
        at = np.cumsum(mine) - 1
        own = mine[rows]
        w, b = fit_one(at[rows[own]], cols[own], positive[mine], prior, len(known))
        weights, bias, n_fit = weights + w, bias + b, n_fit + 1
    return Linear(known, weights / max(n_fit, 1), bias / max(n_fit, 1))


def train(docs: DataFrame, labels: DataFrame) -> Linear:
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")))
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = marked.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE)
    ids = docs.where("doc_id is not null").select("doc_id").where(~held_out(F.col("doc_id")))
    span = 1 << 40
    bound = int(span * min(1.0, MAX_UNLABELLED / max(ids.count(), 1)))
    others = ids.where(F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(span)) < bound).distinct()
    chosen = toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(others.select("doc_id", F.lit(False).alias("positive")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(2)):
                batch = whole.slice(a, b - a)
                sets: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
                for rows, found in features_of(batch.column(2)):
                    cut = np.searchsorted(rows, np.arange(len(batch) + 1))
                    for parts, i, j in zip(sets, cut[:-1], cut[1:]):
                        parts.append(np.unique(found[i:j]))
                sets = [np.unique(np.concatenate(parts)).astype("<u8").tobytes() for parts in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["doc_id", "positive", "words"])

    # Bounded: the sample of ids is about MAX_POSITIVE + MAX_UNLABELLED rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text")
    with batch_rows(spark):
        sample = stored(texts.mapInArrow(features, "doc_id long, positive boolean, words binary"), "toxicity-sample")
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        odds = float(np.clip(prior, 1e-9, 1 - 1e-9))
        nothing = np.zeros(0, np.uint64), np.zeros(0)
        return Linear(*nothing, float(np.log(odds / (1 - odds))) if prior > 0 else -30.0)
    known = screened(sample, sizes[True], sizes[False])
    shared = spark.sparkContext.broadcast(known)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a text's features among the known ones."""
        features = shared.value
        for batch in batches:
            places = []
            for words in batch.column(2).to_pylist():
                w = np.frombuffer(words, "<u8")
                at = np.minimum(np.searchsorted(features, w), max(len(features) - 1, 0))
                places.append((at[features[at] == w] if len(features) else at[:0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], ["doc_id", "positive", "places"])

    found = sample.mapInArrow(entries, "doc_id long, positive boolean, places binary").collect()
    found.sort(key=lambda r: (r.positive, r.doc_id, r.places))
    dropped(sample)
    cols = [np.frombuffer(r.places, "<i4") for r in found]
    rows = np.repeat(np.arange(len(found)), [len(x) for x in cols])
    return fit(known, rows, np.concatenate(cols).astype(np.int64), np.array([r.positive for r in found], bool), float(prior))


def scored(docs: DataFrame, model: Linear, keep: bool = False, below: float | None = None) -> DataFrame:
    """``docs`` (all columns if ``keep``, else doc_id) with the score of each whole text; without it the rows ``below`` one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.features, model.weights, model.bias))
    own = docs.columns if keep else ["doc_id"]
    fields = [docs.schema[c] for c in own]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col("text").alias("t"))
    names = [f"c{i}" for i in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = Linear(*shared.value)
        for whole in batches:
            for a, b in text_slices(whole.column(len(names))):
                batch = whole.slice(a, b - a)
                score = pa.array(linear.scores(batch.column(len(names))), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], score], [*names, "score"])

    small_batches(spark)
    schema = rows.select(*names).schema.add("score", "double")
    out = rows.mapInArrow(run, schema)
    named = [F.col(n).alias(f.name) for n, f in zip(names, fields)]
    return out.select(*named, "score") if below is None else out.where(F.col("score") < below).select(*named)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose score is below the threshold, with all their columns."""
    return scored(docs, train(docs, labels), keep=True, below=THRESHOLD)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
