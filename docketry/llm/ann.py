"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue per query.

Every tree has one random direction for each level; a node divides its vectors at a threshold along it.  Depth grows
with the logarithm of the table, so that leaves hold about ``LEAF_ROWS`` vectors whatever its size.  Thresholds are
medians of a bounded sample (``SAMPLE_ROWS`` vectors, the first by a hash of their ids): one for each node of the
first ``NODE_LEVELS`` levels, one for each level below.  Every vector is indexed in every tree.

A query walks all trees at once: one queue holds the open nodes of all trees by the largest margin on the way to
them, and leaves are taken from it in that order.  How many is measured, not set: the true neighbours of
``TRIAL_QUERIES`` queries, found by brute force over all rows, tell after how many leaves the share ``RECALL`` of
them is met.  Candidates of the leaves are reranked by the exact inner product in double precision.

Leaves are searched where they lie: a task holds one part of a tree (about ``PART_ROWS`` vectors, a subtree) and the
queries that visit leaves of it, and returns one row of at most ``k`` candidates for each.  Parts of more vectors
(copies of one vector cannot be divided) or more queries are split by hashes of the ids.

Defined results: vectors that are null, zero, of another length than the sample's most frequent, or hold null or
non-finite components take no part, and neither do null ids; rows that share an id are one candidate (with its best
score) and are not candidates of their own id; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, dropped, read, small_batches, stored

TREES, LEAF_ROWS, NODE_LEVELS = 16, 48, 9
SAMPLE_ROWS, TRIAL_QUERIES, RECALL = 16_384, 96, 0.94
PART_ROWS, BLOCK_ROWS, BLOCK_QUERIES, SEED = 16_384, 32_768, 4096, 7
#: Leaves that a trial query is followed for at most.
TRIAL_LEAVES = 200_000
VECTOR_ROWS = 2000


@dataclass
class Forest:
    """``directions`` [tree, level, dimension]; thresholds of the upper nodes [tree, node] and of levels [tree, level].

    A node is the number made of the turns to it; node ``i`` of level ``l`` has the threshold ``2 ** l - 1 + i``.
    """

    directions: np.ndarray
    node_thresholds: np.ndarray
    level_thresholds: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int = TREES) -> Forest:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(trees, depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        upper = min(depth, NODE_LEVELS)
        nodes, levels = np.zeros((trees, 2**upper - 1)), np.zeros((trees, depth))
        for t in range(trees):
            along = sample @ directions[t].T
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                levels[t, level] = np.median(along[:, level])
                if level >= upper:
                    continue
                order = np.argsort(node, kind="stable")
                cuts = np.searchsorted(node[order], np.arange(2**level + 1))
                first = 2**level - 1
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    nodes[t, first + i] = np.median(along[order[a:b], level]) if b > a else levels[t, level]
                node = 2 * node + (along[:, level] > nodes[t, first + node])
        return cls(directions, nodes, levels)

    def threshold(self, tree: int, level: int, node):
        """Threshold of a node, or of each of several."""
        if 2**level - 1 < self.node_thresholds.shape[1]:
            return self.node_thresholds[tree, 2**level - 1 + node]
        return self.level_thresholds[tree, level]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, tree]: the leaf that each vector falls into."""
        out = np.zeros((len(vectors), len(self.directions)), np.int64)
        for t, directions in enumerate(self.directions):
            along, node = vectors @ directions.T, np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                node = 2 * node + (along[:, level] > self.threshold(t, level, node))
            out[:, t] = node
        return out

    def search(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the queue that all trees share."""
        along = self.directions @ query
        queue = [(-math.inf, t, 0, 0) for t in range(len(self.directions))]
        while queue:
            bound, t, level, node = heapq.heappop(queue)
            while level < self.depth:  # the nearer side of a node is as near as the node
                m = along[t, level] - self.threshold(t, level, node)
                far, node = (2 * node, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node)
                level += 1
                heapq.heappush(queue, (max(bound, abs(m)), t, level, far))
            yield t, node


def usable(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part; floats stay floats."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size("v") == dimension) & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def hashed_first(rows: DataFrame, n_rows: int, n: int, seed: str) -> list:
    """About the first ``n`` of ``n_rows`` rows by a hash of their ids: a task sends only its share to the driver."""
    h = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 40))
    bound = int((1 << 40) * min(1.0, (n + 4 * math.sqrt(n)) / max(n_rows, 1)))
    return sorted(rows.where(h < bound).select("vec_id", "v").collect(), key=lambda r: (r.vec_id, r.v))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def exact_top(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the nearest; ``rough`` are the inner products, as far as their order may be trusted."""
    rough = np.where(ids == own, -np.inf, rough)
    n = k + len(ids) - len(np.unique(ids))  # rows that share an id count once
    edge = np.partition(rough, len(rough) - n)[len(rough) - n] if len(rough) > n else -np.inf
    near = np.flatnonzero((rough >= edge - 1e-9 * max(1.0, abs(edge))) & (rough > -np.inf)) if edge > -np.inf else np.flatnonzero(rough > -np.inf)
    exact = (x[near] * q).sum(axis=1)
    best = top(exact, ids[near], k)
    return ids[near][best], exact[best]


def leaves_to_visit(rows: DataFrame, trials: list, forest: Forest, k: int) -> int:
    """After how many leaves of its queue a trial query has met ``RECALL`` of its ``k`` true neighbours, over all."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in trials]), np.array([r.v for r in trials], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, q.shape[1])))] * len(q)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for i, rough in enumerate(q @ x.T if len(ids) else []):
                some = np.flatnonzero(ids != ids_of[i])
                a, b, c = np.concatenate((best[i][0], ids[some])), np.concatenate((best[i][1], rough[some])), np.concatenate((best[i][2], x[some]))
                keep = top(b, a, k)
                best[i] = a[keep], b[keep], c[keep]
        found = [(i, int(a), float(b), c.tolist()) for i, x in enumerate(best) for a, b, c in zip(*x)]
        columns = zip(*found) if found else [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["trial", "vec_id", "score", "v"])

    with batch_rows(spark, VECTOR_ROWS):
        found = rows.mapInArrow(run, "trial int, vec_id long, score double, v array<double>")
        # Merged in the executors first, so that the driver gets k rows for each trial query.
        best = found.groupBy("trial").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "vec_id", "v")), asc=False), 1, k).alias("best"))
        best = {r.trial: r.best for r in best.collect()}
    ranks = []
    for i, r in enumerate(trials):
        neighbours = best.get(i, [])
        if not neighbours:
            continue
        where = forest.leaves(np.array([x.v for x in neighbours]))
        missing, wanted = set(range(len(neighbours))), {}
        for j, leaves in enumerate(where.tolist()):
            for t, leaf in enumerate(leaves):
                wanted.setdefault((t, leaf), []).append(j)
        for n, leaf in enumerate(forest.search(np.array(r.v, float)), 1):
            met = missing.intersection(wanted.get(leaf, ()))
            ranks += [n] * len(met)
            missing -= met
            if not missing or n >= TRIAL_LEAVES:
                ranks += [n] * len(missing)
                break
    return sorted(ranks)[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))] if ranks else 1


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``is_query`` holds for."""
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = embeddings.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
    usual = sizes.orderBy(F.col("count").desc(), "n").first()
    if usual is None:
        return empty
    rows = usable(embeddings, usual.n)
    n_rows, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    if not n_queries:
        return empty
    depth = max(0, round(math.log2(n_rows / LEAF_ROWS)))
    forest = Forest.fit(np.array([r.v for r in hashed_first(rows, n_rows, SAMPLE_ROWS, "sample")] or [[0.0] * usual.n], float), depth)
    budget = leaves_to_visit(rows, hashed_first(rows.where(is_query), n_queries, TRIAL_QUERIES, "trial") or rows.where(is_query).limit(1).collect(), forest, k)
    part_levels = min(depth, max(0, math.ceil(math.log2(n_rows / PART_ROWS))))
    shared = spark.sparkContext.broadcast((forest.directions, forest.node_thresholds, forest.level_thresholds))
    kind = rows.schema["v"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest(*shared.value)
        for batch in batches:
            leaves = trees.leaves(_matrix(batch.column(1)))
            n, t = leaves.shape
            at, leaf = pa.array(np.repeat(np.arange(n), t)), leaves.ravel()
            columns = [np.tile(np.arange(t, dtype=np.int32), n), leaf >> (depth - part_levels), leaf]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(at), batch.column(1).take(at)], ["tree", "part", "leaf", "id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest(*shared.value)
        for batch in batches:
            found: list[tuple[int, int, int, list[int]]] = []
            for i, v in enumerate(_matrix(batch.column(1))):
                parts: dict[tuple[int, int], list[int]] = {}
                for _, (t, leaf) in zip(range(budget), trees.search(v)):
                    parts.setdefault((t, leaf >> (depth - part_levels)), []).append(leaf)
                found += [(i, t, part, sorted(leaves)) for (t, part), leaves in parts.items()]
            at, tree, part, leaves = zip(*found) if found else [()] * 4
            at = pa.array(at, pa.int64())
            columns = [pa.array(tree, pa.int32()), pa.array(part, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(at), batch.column(1).take(at)], ["tree", "part", "leaves", "id", "v"])

    with batch_rows(spark, VECTOR_ROWS):
        indexed = stored(rows.mapInArrow(index, f"tree int, part long, leaf long, id long, v {kind}"), "ann-index")
        asked = rows.where(is_query).repartition(F.col("vec_id"))
        visits = stored(asked.mapInArrow(search, f"tree int, part long, leaves array<long>, id long, v {kind}"), "ann-visits")
    key = ["tree", "part"]
    held = indexed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("vbs"))
    held = held.join(visits.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qbs")), key)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block on its own side, once for every block of the other side."""
        t = side.join(held, key).withColumn(own, F.pmod(F.xxhash64("id"), F.col(own + "s")).cast("int"))
        return t.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).drop("vbs", "qbs").groupBy("tree", "part", "vb", "qb")

    def rerank(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(vectors) and len(queries):
            leaf = vectors.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, ids, x = leaf[order], vectors.column("id").to_numpy()[order], _matrix(vectors.column("v"))[order]
            asked = queries.column("id").to_pylist()
            for own, leaves, q in zip(asked, queries.column("leaves").to_pylist(), _matrix(queries.column("v"))):
                first, last = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right")
                runs = [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b > a]
                if not runs:
                    continue
                rough = np.concatenate([x[a:b] @ q for a, b in runs])
                at = np.concatenate([np.arange(a, b) for a, b in runs])
                if len(at) > 4 * k and k:
                    best = np.flatnonzero(rough >= np.partition(rough, len(rough) - 2 * k)[len(rough) - 2 * k] - 1e-9)
                    if len(np.unique(ids[at[best]])) > k:  # the own id may be among them
                        at, rough = at[best], rough[best]
                near, exact = exact_top(x[at], ids[at], q, own, rough, k)
                if len(near):
                    found.append((own, near.tolist(), exact.tolist()))
        columns = zip(*found) if found else [()] * 3
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                ids, scores = np.concatenate([np.array(x, np.int64) for x in ids]), np.concatenate(scores)
                out += [(own, rank, int(ids[i]), float(scores[i])) for rank, i in enumerate(top(scores, ids, k), 1)]
            columns = zip(*out) if out else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"])

    found = dealt(indexed, "vb", "qb").cogroup(dealt(visits, "qb", "vb")).applyInArrow(rerank, "query_id long, ids array<long>, scores array<double>")
    with batch_rows(spark, VECTOR_ROWS):
        found = stored(found, "ann-found")
    dropped(indexed, visits)
    small_batches(spark)
    # A query has at most one row for each leaf of its budget.
    lists = found.groupBy("query_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    return lists.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
