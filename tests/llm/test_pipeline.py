"""The pipeline and the queries with SQL."""

import importlib.util
from pathlib import Path

import numpy as np
import pytest

from docketry.llm import bpe, registry
from tests.compare import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_sql(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    same(spark, registry.queries()[name], registry.oracle_sql()[name], DATA, connect(DATA))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 5000, 30)] + (["vile", "vile"] if i % 7 == 0 else [])
        rows.append((i, " ".join(words), "en", None if i % 11 == 0 else f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 7 == 0)))
    clean = [r for r in rows if r[0] % 7]
    copies = [(1000 + k, "  " + clean[k][1] + "\n", "en", "s1", 1) for k in range(20)]
    near = [(2000 + k, clean[k + 30][1] + " more", "en", "s2", 1) for k in range(20)]
    spark.createDataFrame(rows + copies + near, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/{len(kept)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    toxic_free, distinct, apart, mixed = kept.values()
    assert toxic_free == sorted(i for i, *_ in rows + copies + near if i >= 1000 or i % 7)
    # Of equal texts the longest stays: the copies have three characters more.
    originals = {clean[k][0] for k in range(20)}
    assert distinct == sorted(set(toxic_free) - originals)
    assert apart == sorted(i for i in distinct if i < 2000)
    assert set(mixed) <= set(apart) and max(mixed.count(i) for i in set(mixed)) <= 3
    path, pattern = bpe.vocabulary_path()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.loaded(path, pattern).ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(tokens) == len(mixed) and all(t.n_tokens == len(library.encode_ordinary(texts[t.doc_id])) for t in tokens)


CLASHING = ["names", "parts", "row", "found", "between", "made", "key", "id", "gone", "score", "__score", "__maybe", "__gone", "a.b", "c0", "t"]


def test_columns_that_clash_or_hold_a_dot(spark):
    """Stages and replacement keep columns of any name as they are."""
    from pyspark.sql import functions as F

    from docketry.llm import ngram_join, pii, toxicity

    words = " ".join(f"w{i}" for i in range(30))
    texts = [words, words, "Write to Mr John Smith at a@b.com", None, "You are awful and vile", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in CLASHING])
    labels = spark.createDataFrame([(i, 1, int(i == 4)) for i in range(6)], "doc_id long, quality int, toxic int")
    for out in (ngram_join.one_of_each(docs), toxicity.without_toxic(docs, labels), pii.replaced(docs)):
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and rows
        assert all(r[2 + i] == n for r in rows for i, n in enumerate(CLASHING))
    assert sorted(r[0] for r in ngram_join.one_of_each(docs).collect()) == [0, 2, 3, 4, 5]


def test_long_words_and_many_short_addresses(spark):
    """A word of 200,000 letters and runs of signs take no stack; 676 addresses of one form stay distinct."""
    import string

    from docketry.llm import pii

    long = "Mrs Anna Miller said " + "Ab" * 100_000 + " " + "-" * 60_000 + " " + "a-" * 30_000 + "b and " + "7" * 50_000 + " Miller."
    mails = " ".join(f"{a}{b}@y.com" for a in string.ascii_lowercase for b in string.ascii_lowercase)
    got = {r.doc_id: r.text for r in pii.replaced(spark.createDataFrame([(1, long), (2, mails)], "doc_id long, text string")).collect()}
    assert "Miller" not in got[1] and "Ab" * 1000 in got[1] and "7" * 50_000 in got[1]
    made = got[2].split()
    assert len(set(made)) == 676 and not set(made) & set(mails.split()) and all(m.endswith(".com") and m.count("@") == 1 for m in made)
