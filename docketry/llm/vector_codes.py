"""Vector code compression: product codes whose nearest entries a vantage-point tree finds.

Vectors are quantised and cut into equal consecutive parts.  Each part position has a codebook of at most 16 entries
and, for each round, one vantage-point tree over them: a node is an entry, and its two subtrees hold the nearer and
the farther half of what is left, with the least and the largest distance to the node.  A search takes nodes from a
stack; subtrees whose triangle bound is larger than the best distance so far are left out.  Bounds are rounded so that
they are never too tight (``SLACK``), subtrees at exactly the best distance are visited, and what is compared in the end
are squared distances in integers: ties go to the lower index as they would over all entries.

All searches of an Arrow batch go in step: a search is one row of numpy arrays, every turn takes one node for each search
that is still open.  A task sends one partial sum for each entry and component, so that the driver gets 8 x 16 x 9
numbers a round.

Defined results: rows whose vector is null or holds null or non-finite components are not in the result, and neither are
those of another length than the most frequent one (of equally frequent ones the shorter), which must be a positive
multiple of the number of parts.  Of rows that share an id, the smaller vector counts as first; null ids count as
the largest.  With fewer than 16 vectors codebooks are as short.  Integers saturate (``integers.limit``), and so do sums of
errors at the largest long.  Null labels are a label.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import batch_rows, dropped, read, stored
from docketry.llm.integers import MOST, VECTOR_ROWS, is_finite, limit, matrix, quantised, with_values

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Relative width that distances computed in double precision are widened by, more than all roundings together.
SLACK = 2.0**-48
NONE = -1


@dataclass
class Trees:
    """Vantage-point trees of all parts in flat arrays; the root of a part is its first node.

    ``child`` [node, 2] are the nearer and the farther subtree (``NONE`` where there is none), ``least`` and ``most``
    [node, 2] the bounds of their distances to the node, rounded outwards.
    """

    entry: np.ndarray
    vector: np.ndarray
    child: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def over(cls, codebooks: np.ndarray) -> Trees:
        """Trees over ``codebooks`` [part, entry, component]."""
        parts, n, width = codebooks.shape
        size = parts * n
        out = cls(np.zeros(size, np.int64), codebooks.reshape(size, width).copy(), np.full((size, 2), NONE), np.zeros((size, 2)), np.zeros((size, 2)))
        for p in range(parts if n else 0):
            free = iter(range(p * n, (p + 1) * n))
            out._grow(codebooks[p], np.arange(n), free)
        return out

    def _grow(self, entries: np.ndarray, left: np.ndarray, free: Iterator[int]) -> int:
        node, own, rest = next(free), left[0], left[1:]
        self.entry[node], self.vector[node] = own, entries[own]
        if len(rest):
            square = ((entries[rest] - entries[own]) ** 2).sum(1)
            order = np.argsort(square, kind="stable")
            half = (len(rest) + 1) // 2
            for side, some in enumerate((order[:half], order[half:])):
                if len(some):
                    self.least[node, side] = np.sqrt(float(square[some[0]])) * (1 - SLACK)
                    self.most[node, side] = np.sqrt(float(square[some[-1]])) * (1 + SLACK)
                    self.child[node, side] = self._grow(entries, rest[some], free)
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ``x`` [row, part, component]: the nearest entry of each part and the squared distance, exact."""
        rows, parts, width = x.shape
        n = len(self.entry) // parts
        asked = x.reshape(rows * parts, width)
        best, found = np.full(len(asked), MOST), np.zeros(len(asked), np.int64)
        depth = n.bit_length() + 2
        stack, bound = np.zeros((len(asked), depth), np.int64), np.zeros((len(asked), depth))
        stack[:, 0] = np.tile(np.arange(parts) * n, rows)
        height, at = np.ones(len(asked), np.int64), np.arange(len(asked))
        while len(at):
            height[at] -= 1
            node, low = stack[at, height[at]], bound[at, height[at]]
            reach = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
            near = low <= reach  # at exactly the best distance there may be a lower index
            some, node = at[near], node[near]
            square = ((asked[some] - self.vector[node]) ** 2).sum(1)
            entry = self.entry[node]
            better = (square < best[some]) | ((square == best[some]) & (entry < found[some]))
            best[some[better]], found[some[better]] = square[better], entry[better]
            away = np.sqrt(square.astype(np.float64))
            lows = np.maximum(away[:, None] * (1 - SLACK) - self.most[node], self.least[node] - away[:, None] * (1 + SLACK))
            lows = np.maximum(lows, 0.0)
            # The side with the larger bound goes below the other on the stack; of equal ones the farther half does.
            first = np.where(lows[:, 0] > lows[:, 1], 0, 1)
            for side in (first, 1 - first):
                pick = np.arange(len(some))
                child, low = self.child[node, side], lows[pick, side]
                on = (child != NONE) & (low <= np.sqrt(best[some].astype(np.float64)) * (1 + SLACK))
                to = some[on]
                stack[to, height[to]], bound[to, height[to]] = child[on], low[on]
                height[to] += 1
            at = at[height[at] > 0]
        return found.reshape(rows, parts), best.reshape(rows, parts)


def integer_rows(embeddings: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, q) of the vectors that take part, and their number of components (0 if there are none)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & is_finite(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    width = sizes[0].n if sizes else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = rows.where(F.size("v") == width) if width else rows.limit(0)
    return kept.select("vec_id", "label", quantised(F.col("v"), scale, limit(width)).alias("q")), width


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    x = matrix(column)
    return x.reshape(len(x), parts, -1)


def moved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the column ``q``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Trees.over(codebooks))
    parts, n, width = codebooks.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * n, width + 1), np.int64)
        for batch in batches:
            if len(batch):
                x = _parts(batch.column(0), parts)
                at = shared.value.nearest(x)[0] + np.arange(parts) * n
                np.add.at(total, at.ravel(), np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2).reshape(-1, width + 1))
        sums = pa.array([Decimal(v) for v in total.ravel().tolist()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), sums], ["place", "total"])

    with batch_rows(spark, VECTOR_ROWS):
        sums = rows.select("q").mapInArrow(partial, "place long, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
        found = {r.place: int(r.total) for r in sums.collect()}
    shared.unpersist()
    out = codebooks.reshape(parts * n, width).copy()
    for k in range(len(out)):
        count = found.get(k * (width + 1) + width, 0)
        if count:
            out[k] = [found[k * (width + 1) + i] // count for i in range(width)]
    return out.reshape(codebooks.shape)


def coded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    spark = embeddings.sparkSession
    rows, width = integer_rows(embeddings, parts, scale)
    rows = stored(rows, "codes-rows")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    codebooks = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        codebooks = moved(rows, codebooks)
    shared = spark.sparkContext.broadcast(Trees.over(codebooks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, square = shared.value.nearest(_parts(batch.column(2), parts))
                codes = [bytes(c).hex() for c in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(square.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    with batch_rows(spark, VECTOR_ROWS):
        out = stored(rows.select("vec_id", "label", "q").mapInArrow(assign, schema), "codes-found")
    dropped(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = out.groupBy("label").agg(F.count("*").alias("n"), total.alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    found = with_values(out, stored(labels, "codes-labels"), "label", "n")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings``: 8 parts, 16 entries, 6 rounds."""
    return coded(read(spark, sf_dir, "embeddings"))


_DISTANCE = "list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i])))"


def _nearest_sql(k: int) -> str:
    return f"""(select * from (select p.*, b.e, {_DISTANCE} d, row_number() over (partition by p.r, p.part order by {_DISTANCE}, b.e) o
  from p join b{k} b using (part)) where o = 1)"""


def _round_sql(k: int) -> str:
    return f"""
a{k} as materialized {_nearest_sql(k)},
s{k} as (select part, e, i, sum(c[i]) s, count(*) n from a{k}, range(1, (select max(len(c)) from p) + 1) t(i) group by all),
u{k} as (select part, e, list((s - ((s % n) + n) % n) // n order by i) c from s{k} group by all),
b{k + 1} as materialized (select part, e, coalesce(u.c, b.c) c from b{k} b left join u{k} u using (part, e)),"""


OP13_SQL = (
    """
with v as materialized (select row_number() over () r, row_number() over (order by vec_id nulls last, q) - 1 e, * from (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
p as materialized (select r, vec_id, label, part, q[part * len(q) // 8 + 1 : (part + 1) * len(q) // 8] c, e own from v, range(8) t(part)),
b0 as materialized (select part, own e, c from p where own < 16),"""
    + "".join(map(_round_sql, range(ROUNDS)))
    + f"""
f as materialized {_nearest_sql(ROUNDS)},
o as (select r, any_value(vec_id) vec_id, any_value(label) label, string_agg(lower(printf('%02x', e)), '' order by part) code, sum(d) error from f group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) codebooks_sha256 from b{ROUNDS})
select vec_id, code, error::bigint error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from o, h"""
)
