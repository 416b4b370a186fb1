"""Batches that are killed and gone on with; sentences that are looked up once."""

import pytest
from pyspark.sql import functions as F

from docketry.plans.material import first_sentences, report_rows, sentence_cases
from docketry.sources.incremental import IncrementalTable
from docketry.storage import committed, scratch


def test_a_killed_run_goes_on_behind_its_last_commit(spark):
    table = IncrementalTable(spark, scratch(spark, "incremental"), "id")
    source = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("x"))
    seen = []

    def encoded(rows, fail_at=None):
        if len(seen) == fail_at:
            raise RuntimeError("killed")
        seen.append(rows.count())
        return rows.withColumn("code", F.length("text"))

    with pytest.raises(RuntimeError):
        table.write(source, lambda rows: encoded(rows, 3), batch_rows=20)
    # The fourth batch was written but not committed.
    source.where("id < 3").withColumn("content_hash", F.lit("?")).withColumn("code", F.lit(0)).write.parquet(f"{table.path}/rows/batch=3")
    assert committed(spark, table.path) == [0, 1, 2] and table.rows().count() == sum(seen) < 100
    before = sum(seen)
    table.write(source, encoded, batch_rows=20)
    assert sum(seen) == 100 and sum(seen) - before == 100 - before
    assert sorted((r.id, r.code) for r in table.rows().collect()) == [(i, len(f"t{i}")) for i in range(100)]
    assert table.write(source, encoded) == 0 and sum(seen) == 100
    changed = source.withColumn("text", F.when(F.col("id") == 7, "new text").when(F.col("id") == 8, F.lit(None)).otherwise(F.col("text")))
    assert table.write(changed, encoded) == 1 and sum(seen) == 102
    rows = {r.id: r for r in table.rows().collect()}
    assert len(rows) == 100 and rows[7].code == 8 and rows[8].code is None and set(table.rows().columns) == {"id", "text", "x", "code"}


def test_equal_sentences_are_looked_up_once(spark):
    rows = [("m1", 0, "same words"), ("m1", 1, "other"), ("m2", 0, "same words"), ("m2", 1, "nothing"), ("m3", 0, "same words")]
    asked = []

    def search(queries, k):
        asked.append(sorted(r.text for r in queries.collect()))
        found = [("same words", "C2", 2.0, 1), ("same words", "C1", 2.0, 2), ("same words", "C3", 1.0, 3), ("other", "C9", 5.0, 1)]
        f = spark.createDataFrame(found, "text string, case_id string, score double, rk int")
        return queries.join(f, "text").select("qid", "case_id", "score", "rk")

    s = spark.createDataFrame(rows, "material string, pos int, sentence string")
    out = sentence_cases(s, search, 2)
    got = {(r.material, r.pos): ([tuple(c) for c in r.cases], r.hit_score) for r in out.collect()}
    assert asked == [["nothing", "other", "same words"]] and len(got) == 5
    assert got["m2", 0] == got["m3", 0] == ([(2.0, "C1"), (2.0, "C2")], 2.0) and got["m2", 1] == ([], None)
    report = [(r.material, r.rk, r.pos, r.case_id) for r in report_rows(out, "material").orderBy("material", "rk").collect()]
    assert report == [("m1", 1, 1, "C9"), ("m1", 2, 0, "C1"), ("m2", 1, 0, "C1"), ("m2", 2, 1, None), ("m3", 1, 0, "C1")]
    assert first_sentences(s, "material", 1).count() == 3
