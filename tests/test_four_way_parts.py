"""Parts of the four-channel backend: vectors made where texts are, look-ups of few and of many documents."""

from pyspark.sql import functions as F

from docketry.operators import fulltext
from docketry.operators.fulltext import FullTextIndex
from docketry.operators.permits import Permit
from docketry.plans import backend


def test_vectors_of_texts_are_those_of_counted_tokens(spark):
    texts = [("a", "The cat THE 销售误导 İx K1 x"), ("b", ""), ("c", None), ("d", "!"), ("a", "cat two"), ("e", "y " * 9), ("f", " ".join(f"w{i} w{i % 7}" for i in range(500)))]
    t = spark.createDataFrame(texts, "k string, text string")
    wanted = {r.k: list(r.v) for r in backend.hashed_vectors(backend.token_counts(t, "k"), "k").collect()}
    assert {r.k: list(r.v) for r in backend.text_vectors(t, "k").collect()} == wanted and set(wanted) == {"a", "f"}


def test_vectors_take_one_shuffle(spark):
    """Tokens stay where their text is: one exchange, of vectors."""
    t = spark.createDataFrame([("a", "some words")], "k string, text string")
    assert backend.text_vectors(t, "k")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_few_and_many_looked_up_documents_give_the_same(spark, monkeypatch):
    docs = spark.range(300).select(F.format_string("C%04d", "id").alias("case_id"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("m"), F.col("id") % 7), F.concat(F.lit("n"), F.col("id") % 50)).alias("text"), (F.col("id") % 3 > 0).alias("related"))
    queries = spark.createDataFrame([(1, "all m1 n3"), (2, "all m2 zz n4"), (3, "zz"), (4, "all")], "qid long, text string")
    index, out = FullTextIndex.over(docs), []
    for permit in (None, Permit.of(queries, docs)):
        for most in (0, 200_000):
            monkeypatch.setattr(fulltext, "LOOKED_UP", most)
            out.append(sorted(map(tuple, index.search(queries, 5, permit).collect())))
    assert out[0] == out[1] and out[2] == out[3] and out[0] != out[2]
    assert all(int(case_id[1:]) % 3 > 0 for _, case_id, *_ in out[2])


def test_postings_of_a_batch():
    """Postings of a batch: fields run on, equal tokens of a document are one row, positions in order."""
    import pyarrow as pa

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):
            return f

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["The the x1", None, "!"]), pa.array(["cat THE", "", "案件案件 K9"])], ["case_id", "head", "text"])
    rows = [tuple(r.values()) for b in fulltext.analysed(Docs(), {"head": 2.0, "text": 0.5})(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(rows) == sorted([("the", "a", 3, 4.5, [0, 1, 4]), ("x1", "a", 1, 2.0, [2]), ("cat", "a", 1, 0.5, [3]), ("案件案件", "c", 1, 0.5, [0]), ("k9", "c", 1, 0.5, [1])])
