"""The index of dense vectors: recall, the exact way, deltas, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from docketry.operators.vectorindex import VectorIndex


def clustered(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24))
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 24)) * 0.35


def exact(x, ids, q, k):
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(u(q) @ u(x).T, 6)
    return [[ids[j] for j in np.lexsort((ids, -row))[:k]] for row in scores]


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rk").collect():
        out.setdefault(r.qid, []).append(r.case_id)
    return out


def test_recall_exact_and_deltas(spark):
    x = clustered()
    ids = np.array([f"C{i:05}" for i in range(len(x))])
    odd = [("Z0", None), ("Z1", [0.0] * 24), ("Z2", [1.0] * 23), ("Z3", [float("nan")] + [1.0] * 23), (None, x[0].tolist())]
    table = spark.createDataFrame([*zip(ids.tolist(), x.tolist()), *odd], "case_id string, v array<double>").repartition(4)
    index = VectorIndex.over(table)
    asked = np.concatenate([x[::100] + 0.01, clustered(20, 9)])
    q = spark.createDataFrame([*enumerate(asked.tolist()), (900, None), (901, [1.0])], "qid long, v array<double>")
    truth = exact(x, ids, asked, 20)
    got = lists(index.search(q, 20))
    recall = np.mean([len(set(t) & set(got[i])) / 20 for i, t in enumerate(truth)])
    assert recall >= 0.9 and set(got) == set(range(len(asked))) and index.probes < len(index.centres)
    assert lists(index.search(q, 20, exact=True)) == dict(enumerate(truth))
    assert lists(index.search(q, 20, probes=len(index.centres))) == dict(enumerate(truth))
    gone = [truth[0][0], truth[1][0]]
    index.write(spark.createDataFrame([("NEW", asked[2].tolist()), (truth[3][0], (-asked[3]).tolist())], table.schema), spark.createDataFrame([(g,) for g in gone], "case_id string"))
    again = lists(index.search(q, 20))
    assert gone[0] not in again[0] and gone[1] not in again[1] and again[2][0] == "NEW" and truth[3][0] not in again[3]
    assert index.rows().count() == len(x) - 2 + 1


def test_empty_index(spark):
    none = spark.createDataFrame([], "case_id string, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, v array<double>")
    index = VectorIndex.over(none)
    assert index.search(q, 5).count() == 0 and index.search(q, 5, exact=True).count() == 0 and index.rows().count() == 0
    one = VectorIndex.over(none.union(spark.createDataFrame([("A", [0.0, 3.0])], none.schema)))
    assert lists(one.search(q, 5)) == {1: ["A"]} and one.search(q.where(F.lit(False)), 5).count() == 0
