"""Blocks of queries against blocks of documents give the rows of a plain count."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from docketry.functions.text import TOKEN
from docketry.operators import lexicalblocks
from docketry.operators.fulltext import FullTextIndex


def tables(seed, n_queries=150, n_docs=400):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(n))
    docs = [(f"C{i:06d}", text(r.choice([0, 3, 30, 30, 200]))) for i in range(n_docs)]
    docs += [(f"X{i:06d}", docs[i % 3][1] + " the same words of many copies C1 c2 c3") for i in range(100)]
    queries = [(i, text(r.choice([1, 2, 6, 40]))) for i in range(n_queries)] + [(-1, "the same c1"), (-2, "zz yy"), (-3, "!"), (-4, "The zz the")]
    r.shuffle(docs)
    return queries, docs


def words(text):
    return Counter(w.lower() for w in re.findall(TOKEN, text))


def plain(queries, docs, k):
    """(qid, case_id, score, rk) by counting all pairs."""
    held, out = {}, set()
    for c, t in docs:
        held[c] = held.get(c, Counter()) + words(t)
    for qid, text in queries:
        asked = set(words(text))
        found = sorted((-len(asked & set(h)), -sum(h[t] for t in asked), c) for c, h in held.items() if asked & set(h))
        whole = [f for f in found if -f[0] == len(asked)] or found
        out |= {(qid, c, float(-n), i + 1) for i, (n, _, c) in enumerate(whole[:k])}
    return out


@pytest.mark.parametrize("postings, documents", [(1, 1), (50, 7), (2000, 4096), (1 << 18, 4096)])
def test_chunks_of_any_size_leave_the_same_best(monkeypatch, postings, documents):
    monkeypatch.setattr(lexicalblocks, "CHUNK_POSTINGS", postings)
    monkeypatch.setattr(lexicalblocks, "CHUNK_DOCUMENTS", documents)
    monkeypatch.setattr(lexicalblocks, "STEP_LOOKUPS", 64)
    queries, docs = tables(documents)
    docs += [(docs[0][0], "one more text of the same id, zz")]  # counts with the other
    asked = [(q, " ".join(words(t))) for q, t in queries if words(t)]
    left = pa.table({"tokens": [t for _, t in asked], "h": pa.array([1] * len(asked), pa.int32()), "w": [0.0] * len(asked)})
    best = lexicalblocks._Best(left, 5).among(pa.table({"case_id": [c for c, _ in docs], "text": [t for _, t in docs]}))
    for (qid, text), hits, weights, at in zip(asked, best.hits, best.weights, best.docs):
        tokens = set(text.split())
        found = sorted((-len(tokens & set(h)), -sum(h[t] for t in tokens), c) for c, h in _held(docs).items() if tokens & set(h))[:5]
        assert [(-h, -w, best.ids[d]) for h, w, d in zip(hits, weights, at) if h] == found, qid


def _held(docs):
    held = {}
    for c, t in docs:
        held[c] = held.get(c, Counter()) + words(t)
    return held


def test_queries_and_documents_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexicalblocks, "QUERY_BLOCK", 40)
    monkeypatch.setattr(lexicalblocks, "DOCUMENT_BYTES", 8000)
    monkeypatch.setattr(lexicalblocks, "FIRST_BYTES", 2000)
    queries, docs = tables(3)
    q, d = spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame([*docs, ("Z", None), ("Z1", "")], "case_id string, text string")
    got = {tuple(r) for r in lexicalblocks.search(q, d, 5).collect()}
    assert got == plain(queries, docs, 5)
    index = FullTextIndex.over(d).search(q, 5)
    assert got == {(r.qid, r.case_id, float(r.n_hits), r.rk) for r in index.collect()}
    assert lexicalblocks.search(q, d.limit(0), 5).count() == 0 == lexicalblocks.search(q.where("qid = -3"), d, 5).count()
