"""A stored index of dense vectors by coarse cells, kept by deltas.

Cells are the centres of k-means over a bounded sample of unit vectors.  A batch of vectors is written with the cell of
each; a later batch replaces the vectors it names and may delete others, and counts once its commit is written.  How many
cells a query probes is measured, not set: the true neighbours of ``TRIALS`` stored vectors and of as many means of two of
them (queries need not be like what is stored), found over all rows, tell after how many of their nearest cells the share
``RECALL`` of them is met for both kinds.  A search reads the probed cells only; ``exact`` scores
all rows instead.  Vectors that are null, zero, of another length, or hold null or non-finite components are not indexed,
and such queries find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import retrieval as R
from docketry.operators.permits import Permit
from docketry.storage import commit, committed, scratch, stored

#: Rows that centres are fitted to, rounds of the fit, rows of a cell aimed at, and cells at most.
SAMPLE_ROWS, ROUNDS, CELL_ROWS, MAX_CELLS = 20_000, 8, 256, 4096
TRIALS, TRIAL_DEPTH, RECALL, SEED = 64, 20, 0.95, 11
#: Rows of a cell that one task scores at most; larger cells are cut.
BLOCK_ROWS = 8192


def usable(vectors: DataFrame, key: str, dimension: int | None = None) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(key, F.col("v").cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows if dimension is None else rows.where(F.size("v") == dimension)


def unit(rows: list | pa.Array) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in rows]) if isinstance(rows, list) else rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit centres by k-means on unit vectors; a centre that loses all its vectors stays."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        at = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


class VectorIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._centres: np.ndarray | None = None

    @classmethod
    def over(cls, vectors: DataFrame) -> VectorIndex:
        """A new index, in a scratch folder, over (case_id, v)."""
        index = cls(vectors.sparkSession, scratch(vectors.sparkSession, "vectors"))
        index.write(vectors)
        return index

    @property
    def centres(self) -> np.ndarray:
        """[cell, component]; at most ``MAX_CELLS`` rows."""
        if self._centres is None:
            rows = sorted(self.spark.read.schema("cell int, v array<double>").parquet(f"{self.path}/centres").collect(), key=lambda r: r.cell)
            self._centres = np.array([r.v for r in rows])
        return self._centres

    @property
    def probes(self) -> int:
        return self.spark.read.schema("probes int").parquet(f"{self.path}/probes").first().probes

    def fit(self, vectors: DataFrame) -> None:
        """Centres of a sample: the rows whose ids hash lowest, about ``SAMPLE_ROWS``."""
        n = vectors.count()
        span = 1 << 40
        bound = int(span * min(1.0, (SAMPLE_ROWS + 4 * math.sqrt(SAMPLE_ROWS)) / max(n, 1)))
        width = [r.n for r in vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
        chosen = vectors.where(F.pmod(F.xxhash64("case_id"), F.lit(span)) < bound).where(F.size("v") == (width[0] if width else 0))
        rows = sorted((r.case_id, r.v) for r in chosen.dropDuplicates(["case_id"]).limit(2 * SAMPLE_ROWS).collect())
        cells = min(MAX_CELLS, max(1, n // CELL_ROWS), max(1, len(rows)))
        c = centres_of(unit([v for _, v in rows]), cells) if rows else np.zeros((0, 0))
        self.spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self._centres = None

    def _celled(self, rows: DataFrame, key: str, n: int) -> DataFrame:
        """(key, v, cells): the ``n`` nearest cells of each row, nearest first."""
        shared = self.spark.sparkContext.broadcast(self.centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and len(shared.value):
                    order = np.argsort(-(unit(batch.column(1)) @ shared.value.T), axis=1, kind="stable")[:, :n]
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, cells], [key, "v", "cells"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, "v").mapInArrow(place, f"{key} {kind}, v array<double>, cells array<int>")

    def write(self, vectors: DataFrame, removed: DataFrame | None = None) -> int:
        """One batch: vectors are added or replaced, the case ids of ``removed`` deleted; the first fits the cells."""
        batches = committed(self.spark, self.path)
        batch = batches[-1] + 1 if batches else 0
        if not batches:
            self.fit(usable(vectors, "case_id"))
        width = self.centres.shape[1] if len(self.centres) else 0
        rows = self._celled(usable(vectors, "case_id", width), "case_id", 1).select("case_id", "v", F.col("cells")[0].alias("cell"))
        rows.repartitionByRange("cell", F.xxhash64("case_id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")
        if batches or removed is not None:
            named = vectors.select("case_id") if removed is None else vectors.select("case_id").unionByName(removed.select("case_id"))
            named.distinct().write.mode("overwrite").parquet(f"{self.path}/named/batch={batch}")
        if not batches:
            probes = self._measured(self.spark.read.schema("case_id string, v array<double>, cell int").parquet(f"{self.path}/cells/batch=0"))
            self.spark.range(1).select(F.lit(probes).cast("int").alias("probes")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        commit(self.spark, self.path, batch)
        return batch

    def _measured(self, rows: DataFrame) -> int:
        """Cells that must be probed for the recall asked for; a stored vector is not its own neighbour."""
        trials = sorted((r.case_id, r.v) for r in rows.orderBy(F.xxhash64("case_id"), "case_id").limit(TRIALS).select("case_id", "v").collect())
        if not trials:
            return 1
        stored_ones = unit([v for _, v in trials])
        means = stored_ones + np.roll(stored_ones, 1, axis=0)
        means = np.where(np.linalg.norm(means, axis=1, keepdims=True) > 1e-9, means, stored_ones)
        own, asked = [i for i, _ in trials] + [None] * len(trials), np.concatenate([stored_ones, unit(list(means))])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    ids, scores = np.array(batch.column(0).to_pylist(), object), asked @ unit(batch.column(1)).T
                    scores[np.array(own, object)[:, None] == ids[None, :]] = -2.0
                    at = np.argsort(-scores, axis=1, kind="stable")[:, :TRIAL_DEPTH]
                    n = np.repeat(np.arange(len(asked)), at.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), batch.column(2).take(pa.array(at.ravel())), pa.array(scores[n, at.ravel()])], ["qid", "cell", "score"])

        near = rows.select("case_id", "v", "cell").mapInArrow(best, "qid int, cell int, score double").where("score > -2")
        top = R.top(near, TRIAL_DEPTH, F.col("score").desc(), F.col("cell")).select("qid", "cell").collect()  # 2 * TRIALS * TRIAL_DEPTH rows at most
        order = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1, kind="stable"), axis=1)
        kinds = [np.sort([order[r.qid, r.cell] + 1 for r in top if (r.qid < len(trials)) == first]) for first in (True, False)]
        return max((int(needed[math.ceil(RECALL * len(needed)) - 1]) for needed in kinds if len(needed)), default=1)

    def rows(self) -> DataFrame:
        """(case_id, v, cell) as of the last commit."""
        batches = committed(self.spark, self.path)
        schema = "case_id string, v array<double>, cell int, batch int"
        if not batches:
            return self.spark.createDataFrame([], schema).drop("batch")
        read = lambda table, schema, which: self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/batch={b}" for b in which])
        rows = read("cells", schema, batches)
        if len(batches) > 1:
            newest = read("named", "case_id string, batch int", batches[1:]).groupBy("case_id").agg(F.max("batch").alias("newest"))
            rows = rows.join(newest, "case_id", "left").where(F.col("newest").isNull() | (F.col("batch") >= F.col("newest")))
        return rows.select("case_id", "v", "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, permit: Permit | None = None) -> DataFrame:
        """(qid, case_id, score, rk): the ``k`` best by cosine of (qid, v) in the probed cells, or among all if ``exact``."""
        kind = queries.schema["qid"].dataType.simpleString()
        if not committed(self.spark, self.path) or not len(self.centres):
            return self.spark.createDataFrame([], f"qid {kind}, case_id string, score double, rk int")
        asked = usable(queries, "qid", self.centres.shape[1])
        if exact:
            return R.dense(asked, self.rows(), k, permit=permit).select("qid", "case_id", "score", "rk")
        rows = permit.restrict(self.rows()) if permit else self.rows()
        wanted = stored(self._celled(asked, "qid", probes or self.probes).select("qid", "v", F.explode("cells").alias("cell")), "vectors-asked")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        sizes = F.broadcast(stored(sizes, "vectors-sizes"))  # at most MAX_CELLS rows
        q = wanted.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "v")
        c = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("case_id"), F.col("blocks")).cast("int").alias("block"), "case_id", "v")
        filtered = permit is not None and permit.asked is not None

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            names, types = ["qid", "case_id", "score"], [left.schema.field("qid").type, pa.string(), pa.float64()]
            if not len(left) or not len(right):
                return pa.table([pa.array([], t) for t in types], names)
            a, b = left.combine_chunks(), right.combine_chunks()
            scores = np.round(unit(a.column("v").chunk(0)) @ unit(b.column("v").chunk(0)).T, 6)
            place = np.argsort(np.argsort(np.array(b.column("case_id").to_pylist(), object)))
            keep = scores.shape[1] if filtered else k  # what a filter takes away later must not have displaced others
            best = np.stack([np.lexsort((place, -row))[:keep] for row in scores])
            at = np.repeat(np.arange(len(scores)), best.shape[1])
            return pa.table([a.column("qid").take(pa.array(at)), b.column("case_id").take(pa.array(best.ravel())), pa.array(scores[at, best.ravel()])], names)

        found = q.groupBy("cell", "block").cogroup(c.groupBy("cell", "block")).applyInArrow(nearest, f"qid {kind}, case_id string, score double")
        return R.top(permit.pairs(found) if filtered else found, k).select("qid", "case_id", "score", "rk")
