"""Centroid clustering and vector codes against brute force in Python integers, on odd rows, ties and copies."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import centroids, integers, vector_codes
from docketry.llm.registry import oracle_sql, queries
from tests.compare import connect, same

SCHEMA = "vec_id long, embedding array<float>, label int, q string, n string, cluster string, code string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "q", "n", "c", "d") for i, v, y in rows], SCHEMA).repartition(3)


def odd_vectors(seed=5, n=220):
    """Clustered vectors, a third of them one vector, ids that repeat, nulls, other lengths, components not finite or very large."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 64))
    rows = [(i, (centres[i % 7] + rng.normal(size=64) * 0.3).astype(np.float32).tolist(), None if i % 11 == 0 else i % 4) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(n // 2)]
    rows += [(5, rows[9][1], 2), (None, rows[10][1], 3), (2000, [0.0] * 64, 0), (2001, [-1e-9] * 64, 0), (2002, [3e38] * 64, 0), (2003, [-5e5] + [0.25] * 63, None)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [NAN] + [1.0] * 63, [1.0] * 63 + [INF]]
    return rows + [(3000 + i, v, 9) for i, v in enumerate(bad)]


def whole(v, scale):
    most = integers.limit(len(v))
    return tuple(min(max(math.floor(scale * x), -most), most) if abs(x) < 1e300 else most for x in v)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(q, entries):
    return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(entries))


def brute_clusters(rows):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if fine(v) and len(v) == 64]
    c = [q for _, q in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:16]]
    for r in range(4):
        at = [nearest(q, c) for _, q in kept]
        if r < 3:
            for k in range(len(c)):
                mine = [q for (_, q), (_, j) in zip(kept, at) if j == k]
                if mine:
                    c[k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    own = [sum(d for d, j in at if j == k) for k in range(len(c))]
    cut = lambda x: min(x, integers.MOST)
    return sorted(((i, j, d, cut(own[j]), cut(sum(own)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)), key=repr)


def brute_codes(rows):
    kept = [(i, y, whole(v, 4096)) for i, v, y in rows if fine(v) and len(v) == 64]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:16]
    part = lambda q, p: q[8 * p : 8 * p + 8]
    books = [[part(q, p) for *_, q in first] for p in range(8)]
    for r in range(7):
        at = [[nearest(part(q, p), books[p]) for p in range(8)] for *_, q in kept]
        if r < 6:
            for p in range(8):
                for k in range(len(books[p])):
                    mine = [part(q, p) for (*_, q), a in zip(kept, at) if a[p][1] == k]
                    if mine:
                        books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in a) for a in at]
    by = {}
    for (_, y, _), e in zip(kept, errors):
        by[y] = by.get(y, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), e, min(by[y], integers.MOST), digest) for (i, y, _), a, e in zip(kept, at, errors)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [False, True])
def test_clusters_match_brute_force(spark, few):
    rows = odd_vectors()
    rows = rows[:5] + rows[-3:] if few else rows
    assert rows_of(centroids.clustered(table(spark, rows))) == brute_clusters(rows)


@pytest.mark.parametrize("few", [False, True])
def test_codes_match_brute_force(spark, few):
    rows = [(i, v, y) for i, v, y in odd_vectors(8)]
    rows = rows[:5] + rows[-3:] if few else rows
    assert rows_of(vector_codes.coded(table(spark, rows))) == brute_codes(rows)


def test_vectors_that_take_no_part(spark):
    bad = table(spark, odd_vectors()[-7:])
    assert centroids.clustered(bad).count() == 0 and centroids.clustered(bad.limit(0)).count() == 0
    assert vector_codes.coded(bad.limit(0)).count() == 0 and vector_codes.coded(bad.where("vec_id in (3000, 3004, 3005, 3006)")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.coded(bad.where("vec_id = 3002"))
    nobody = table(spark, [(None, [0.5] * 64, 1), (None, [0.1] * 64, None)])
    assert {r.cluster for r in centroids.clustered(nobody).collect()} == {0, 1}
    assert rows_of(vector_codes.coded(nobody)) == brute_codes([(None, [0.5] * 64, 1), (None, [0.1] * 64, None)])


def test_sums_beyond_a_long():
    x, n = np.array([[1 << 27, -(1 << 27)]] * 3, np.int64), np.array([1 << 40] * 3, np.int64)
    got = centroids.weighted_sums(x, n, np.array([0, 1, 1]), 2)
    assert got.tolist() == [[1 << 67, -(1 << 67), 1 << 40], [1 << 68, -(1 << 68), 1 << 41]]


def test_trees_find_what_all_entries_would():
    rng = np.random.default_rng(2)
    for n, width, spread in ((16, 8, 3000), (16, 2, 2), (1, 8, 50), (5, 3, 1), (16, 8, 1 << 26), (16, 1, 6)):
        books = rng.integers(-spread, spread + 1, (8, n, width))
        books[:, n // 2] = books[:, 0]  # equal entries
        x = rng.integers(-spread, spread + 1, (400, 8, width))
        x[:50] = books[:, rng.integers(0, n, 50)].transpose(1, 0, 2)
        x[50:90] = (books[:, [0]] + books[:, [n - 1]]).transpose(1, 0, 2) // 2  # as far from two entries, or nearly
        at, square = vector_codes.Trees.over(books).nearest(x)
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        assert (at == d.argmin(2)).all() and (square == d.min(2)).all()


def test_trees_leave_entries_out():
    """On parts that lie near entries most subtrees are never visited."""
    rng = np.random.default_rng(4)
    books = rng.integers(-4000, 4000, (1, 16, 8))
    trees, seen = vector_codes.Trees.over(books), []
    vector = trees.vector

    class Counted:
        def __getitem__(self, at):
            seen.append(len(at))
            return vector[at]

    trees.vector = Counted()
    x = books[0, rng.integers(0, 16, 1000)][:, None] + rng.integers(-200, 200, (1000, 1, 8))
    at, _ = trees.nearest(x)
    assert (at[:, 0] == ((x - books) ** 2).sum(2).argmin(1)).all() and sum(seen) < 0.6 * 16 * 1000


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 700).cast("int").alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = integers.with_values(rows, values, "k", "n")
    assert got.columns == ["k", "id", "n"]
    assert rows_of(got.groupBy("k", "n").count()) == rows_of(values.select("k", "n", F.col("n").alias("count")))
    assert got.select("id").distinct().count() == 3000 == got.count()


@pytest.mark.parametrize("name", ["op11_centroids", "op13_vector_codes"])
def test_vector_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    same(spark, queries()[name], oracle_sql()[name], folder, connect(folder))
