"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers.  Equal ones are one row with a multiplicity; the rounds of Lloyd's algorithm run
over these distinct rows only, with sums weighted by multiplicity, in exact integers; at the end the assignments are
joined back to the ids.  A task sends one partial sum for each cluster and component, so that the driver gets
16 x 65 numbers a round, whatever the table.

Defined results: rows whose vector is null, of another length than ``DIMENSION``, or holds null or non-finite
components are not in the result.  A null id has no hash: such a row is assigned, but is a start only if all ids are
null (then the smallest vectors are the starts).  Rows that share an id are told apart by their vectors.  With fewer
than 16 vectors there are as many centroids.  Integers saturate (``integers.limit``), and so do sums of distances at the
largest long.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, dropped, read, stored
from docketry.llm.integers import VECTOR_ROWS, as_long, is_finite, limit, matrix, quantised, with_values

DIMENSION, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3


def integer_rows(embeddings: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == dimension) & is_finite(F.col("v")))
    return rows.select("vec_id", quantised(F.col("v"), scale, limit(dimension)).alias("q"))


def starts(rows: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the ``n`` smallest hashes, in their order."""
    hashed = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return np.array([r.q for r in hashed.orderBy("h", "q").limit(n).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the squared distance; both exact."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    # Below that, all products and sums are whole numbers that a double holds.
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def weighted_sums(x: np.ndarray, n: np.ndarray, at: np.ndarray, clusters: int) -> np.ndarray:
    """[cluster, component] sums of ``n`` times each row, the last column the sums of ``n``, as Python integers."""
    rows = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
    fits = int(n.astype(object).sum()) * int(np.abs(rows).max(initial=0)) < 1 << 62
    kind = np.int64 if fits else object
    mine = (at[None, :] == np.arange(clusters)[:, None]).astype(kind)
    return (mine @ (rows.astype(kind) * n.astype(kind)[:, None])).astype(object)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over (q, n)."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros((len(c), c.shape[1] + 1), object)
        for batch in batches:
            if len(batch):
                x, n = matrix(batch.column(0)), batch.column(1).to_numpy()
                total += weighted_sums(x, n, nearest(x, c)[0], len(c))
        place = np.arange(total.size)
        sums = pa.array([Decimal(v) for v in total.ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), sums], ["place", "total"])

    with batch_rows(spark, VECTOR_ROWS):
        parts = distinct.mapInArrow(partial, "place long, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
        found = {r.place: int(r.total) for r in parts.collect()}
    shared.unpersist()
    width = centroids.shape[1] + 1
    out = centroids.copy()
    for k in range(len(out)):
        n = found.get(k * width + width - 1, 0)
        if n:
            out[k] = [found[k * width + i] // n for i in range(width - 1)]
    return out


def clustered(embeddings: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, n: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, dimension, scale)
    distinct = stored(rows.groupBy("q").agg(F.count("*").alias("n")), "centroid-distinct")
    centroids = starts(rows, n)
    if not len(centroids):  # ids are all null, or there is nothing
        first = distinct.orderBy("q").limit(n).collect()
        centroids = np.array([r.q for r in first], np.int64).reshape(len(first), dimension)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, d = nearest(matrix(batch.column(0)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["q", "n", "cluster", "distance"])

    with batch_rows(spark, VECTOR_ROWS):
        assigned = stored(distinct.mapInArrow(assign, "q array<int>, n long, cluster int, distance long"), "centroid-assigned")
    dropped(distinct)
    weight = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(weight).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    found = with_values(rows, assigned, "q", "n")
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of([as_long(inertia.get(k, 0)) for k in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(as_long(sum(inertia.values()))).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted integer Lloyd over the distinct quantised vectors of ``embeddings``."""
    return clustered(read(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    return f"""
a{k} as materialized (select q, n, k from (select d.q, d.n, c.k, row_number() over (partition by d.q order by {_DISTANCE}, c.k) r from d, c{k} c) where r = 1),
s{k} as (select k, i, sum(n * q[i]) s, sum(n) n from a{k}, range(1, 65) t(i) group by all),
u{k} as (select k, list((s - ((s % n) + n) % n) // n order by i) c from s{k} group by k),
c{k + 1} as materialized (select c.k, coalesce(u.c, c.c) c from c{k} c left join u{k} u using (k)),"""


_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (d.q[i] - c.c[i]) * (d.q[i] - c.c[i])))"
OP11_SQL = (
    """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
d as materialized (select q, count(*) n from v group by q),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), q) - 1 k, q c from v where vec_id is not null qualify k < 16),"""
    + "".join(map(_round_sql, range(ROUNDS)))
    + f"""
f as materialized (select q, n, k, distance from (select d.q, d.n, c.k, {_DISTANCE} distance, row_number() over (partition by d.q order by {_DISTANCE}, c.k) r from d, c{ROUNDS} c) where r = 1),
i as (select k, sum(n * distance) cluster_inertia from f group by k)
select vec_id, k::int as cluster, distance::bigint distance, cluster_inertia::bigint cluster_inertia, (select sum(cluster_inertia) from i)::bigint inertia,
  sha256(array_to_string(c.c, ',')) centroid_sha256
from v join f using (q) join i using (k) join c{ROUNDS} c using (k)"""
)
