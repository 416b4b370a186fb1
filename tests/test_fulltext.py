"""The full-text index against brute force, its deltas, permits, the rule cascade, isolated channels, the four-way backend."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.functions.text import TOKEN
from docketry.operators import retrieval, tables
from docketry.operators.fulltext import FullTextIndex
from docketry.operators.permits import Permit
from docketry.plans.channels import isolated
from docketry.plans.four_way import FourWay
from docketry.storage import committed


def tokens(text):
    return [w.lower() for w in re.findall(TOKEN, text or "")]


def brute(queries, docs, k, allowed=lambda q, c: True):
    out = []
    for qid, text in queries:
        asked = set(tokens(text))
        scored = []
        for case, body in docs:
            words = tokens(body)
            hits = asked & set(words)
            if hits and allowed(qid, case):
                scored.append((-len(hits), -sum(w in hits for w in words), case))
        if any(-s[0] == len(asked) for s in scored):
            scored = [s for s in scored if -s[0] == len(asked)]
        out += [(qid, c, -n, rk) for rk, (n, _, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n=160):
    """Few frequent and many rare tokens; every fifth document is very short, one is very long, some are equal."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    docs = [(f"C{i:04}", " ".join(word() for _ in range(rng.choice([2, 20, 60, 90, 5])))) for i in range(n)]
    docs += [("C9000", " ".join(f"w{i % 450}" for i in range(4000))), ("C9001", docs[3][1]), ("C9002", None), ("C9003", ""), ("C9004", "．。 a b")]
    queries = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(40)] + [(90, "zz"), (91, ""), (92, None), (93, docs[7][1]), (94, "w1 zz W1")]
    return docs, queries


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "case_id string, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string")


def found(df):
    return sorted((r.qid, r.case_id, r.n_hits, r.rk) for r in df.collect())


@pytest.mark.parametrize("k", [3, 40])
def test_search_matches_brute_force(spark, k):
    docs, queries = corpus(k)
    d, q = frames(spark, docs, queries)
    assert found(FullTextIndex.over(d).search(q, k)) == brute(queries, docs, k)


def test_deltas_and_a_batch_that_was_not_finished(spark):
    docs, queries = corpus(5, 60)
    d, q = frames(spark, docs, queries)
    index = FullTextIndex.over(d)
    new = [("C0001", "w1 w2 fresh"), ("C7000", "fresh w3"), ("C9000", "w1")]
    gone = spark.createDataFrame([("C0002",), ("C5555",)], "case_id string")
    index.write(spark.createDataFrame(new, d.schema), gone)
    held = {c: t for c, t in docs if c != "C0002"} | dict(new)
    asked = [*queries, (95, "fresh")]
    q = spark.createDataFrame(asked, q.schema)
    assert found(index.search(q, 10)) == brute(asked, held.items(), 10)
    # A writer that dies before its commit: what it wrote does not count, and the batch can be written again.
    spark.createDataFrame([("w1", "C0003", 1, 1.0, [0], 0)], "token string, case_id string, tf int, weight double, positions array<int>, bucket int").write.partitionBy("bucket").parquet(f"{index.path}/postings/batch=2")
    assert committed(spark, index.path) == [0, 1] and found(index.search(q, 10)) == brute(asked, held.items(), 10)
    assert index.write(spark.createDataFrame([("C0003", "w2")], d.schema)) == 2
    held["C0003"] = "w2"
    assert found(index.search(q, 10)) == brute(asked, held.items(), 10)


def test_empty_index_and_key_words(spark):
    docs, queries = corpus(6, 40)
    d, q = frames(spark, docs, queries)
    assert FullTextIndex.over(d.limit(0)).search(q, 5).count() == 0 and FullTextIndex.over(d).search(q.limit(0), 5).count() == 0
    index = FullTextIndex.over(d)
    for keyword in ("w1", "W2, w1", "zz", "。"):
        expected = sorted(c for c, t in docs if tokens(keyword) and set(tokens(keyword)) <= set(tokens(t)))
        listed = d.withColumnRenamed("text", "violation_behavior")
        assert sorted(r.case_id for r in tables.apply_filter(listed, tables.CaseFilter(keyword=keyword), index).collect()) == expected
        assert sorted(r.case_id for r in tables.apply_filter(listed, tables.CaseFilter(keyword=keyword)).collect()) == expected


def test_fields_weigh_and_headlines_show_the_first(spark):
    rows = [("A", "key x1 x2", "none"), ("B", "none", "key key"), ("C", " ".join(["pad"] * 70 + ["key"] + ["gap"] * 30 + ["Key", "other"] + ["end"] * 60), "key")]
    d = spark.createDataFrame(rows, "case_id string, text string, penalty string")
    index = FullTextIndex.over(d, {"text": 3.0, "penalty": 1.0})
    q = spark.createDataFrame([(1, "key")], "qid long, text string")
    ranked = index.search(q, 5)
    assert [(r.case_id, r.weight) for r in ranked.orderBy("rk").collect()] == [("C", 7.0), ("A", 3.0), ("B", 2.0)]
    lines = {r.case_id: r.headline for r in index.headlines(ranked, q, d).collect()}
    assert lines["A"] == "<mark>key</mark> x1 x2" and lines["B"] is None
    words = lines["C"].split()
    assert words[0] == "<mark>key</mark>" and words[-1] == "<mark>Key</mark>" and len(words) == 32


def test_permits(spark):
    docs, queries = corpus(7, 80)
    d, q = frames(spark, docs, queries)
    cases = d.select("case_id", (F.substring("case_id", 5, 1) != "3").alias("related"), F.when(F.substring("case_id", 4, 1) < "4", "x").alias("regulator"), F.array(F.substring("case_id", 5, 1)).alias("risk_type_ids"), F.date_add(F.lit("2024-01-01").cast("date"), F.substring("case_id", 5, 1).cast("int")).alias("publish_date"))
    n = F.col("qid")
    q = q.withColumn("regulator", F.when(n % 2 == 0, "x").otherwise("")).withColumn("risk_type", F.when(n % 5 == 1, "4")).withColumn("date_to", F.when(n % 3 == 1, "2024-01-05"))

    def allowed(qid, c):
        last = c[4]
        return last != "3" and (qid % 2 or c[3] < "4") and (qid % 5 != 1 or last == "4") and (qid % 3 != 1 or last <= "4")

    permit = Permit.of(q, cases)
    assert found(FullTextIndex.over(d).search(q.select("qid", "text"), 7, permit)) == brute(queries, docs, 7, allowed)
    v = d.select("case_id", F.array(F.lit(1.0), F.substring("case_id", 2, 4).cast("double") / 9000).alias("v"))
    near = retrieval.dense(q.select("qid", F.array(F.lit(0.2), F.col("qid") / 50).alias("v")), v, 500, permit=permit)
    assert {(r.qid, r.case_id) for r in near.collect()} == {(i, c) for i, _ in queries for c, _ in docs if allowed(i, c)}


ENTRIES = [("红利", "合同以外利益", "R002", 0.9), ("保本", "承诺收益 欺骗", "R001", 0.8), ("首年", "查无此词", "R003", 0.7), ("名额", "查无此词", None, 0.6)]
CASES = [("C1", "给予 合同以外利益", ["R002"]), ("C2", "承诺收益 误导", ["R001"]), ("C3", "其他行为", ["R003"]), ("C4", "其他行为", ["R003", "R001"])]


def rule_tables(spark):
    c = spark.createDataFrame([(i, t, r, 0.5, True) for i, t, r in CASES], "case_id string, text string, risk_type_ids array<string>, confidence double, related boolean")
    return c, spark.createDataFrame(ENTRIES, "business_term string, standard_term string, risk_id string, weight double")


def test_rule_cascade_ends_in_every_tier(spark):
    c, entries = rule_tables(spark)
    q = spark.createDataFrame([(1, "分红利了"), (2, "保本保息"), (3, "首年免费"), (4, "名额有限"), (5, "无关"), (6, "首年保本")], "qid long, text string")
    got = sorted((r.qid, r.case_id, r.tier, r.reason) for r in retrieval.rule_channel(q, FullTextIndex.over(c), entries, c, 30).collect())
    assert got == [
        (1, "C1", "and", "命中规则词典：红利"), (2, "C2", "or", "命中规则词典：保本"), (3, "C3", "ids", "命中规则词典：首年"), (3, "C4", "ids", "命中规则词典：首年"),
        (6, "C2", "or", "命中规则词典：保本、首年"),
    ]


def four_way_cases(spark):
    c, entries = rule_tables(spark)
    c = c.withColumn("violation_behavior", F.col("text")).withColumn("penalty_content", F.lit("")).withColumn("penalty_doc_no", F.lit(None).cast("string"))
    return c.withColumn("risk_tags", F.when(F.col("case_id") == "C1", F.array(F.lit("合同外利益"))).otherwise(F.array(F.lit("销售误导")))), entries


def test_one_channel_raises_and_the_rest_answer(spark):
    c, entries = four_way_cases(spark)
    q = spark.createDataFrame([(1, "分红利了 合同以外利益"), (2, "无关 词")], "qid long, text string")

    def broken(asked):
        return asked.select("qid", F.lit("C1").alias("case_id"), F.raise_error(F.lit("down")).cast("double").alias("score"), F.lit(1).alias("rk"))

    answer = FourWay(entries, extra={"late": broken, "plan": lambda asked: asked.select("nothing")}).retrieve(q, c, FullTextIndex.over(c))
    status = {r.channel: r for r in answer.status.collect()}
    assert {n for n, r in status.items() if not r.ok} == {"late", "plan"} and "down" in status["late"].error and status["rule"].rows == 1
    best = [r for r in answer.results.where("qid = 1").orderBy("rk").collect()]
    assert best[0].case_id == "C1" and best[0].reason.startswith("命中规则词典：红利") and {"bm25", "rule"} <= set(best[0].channels)
    tags = {r.qid: r.tags for r in answer.queries.collect()}
    assert "合同外利益" in tags[1]


def test_all_channels_fail(spark):
    rows, status = isolated(spark, {"a": lambda: 1 / 0, "b": lambda: spark.range(3).select("no")}, "long")
    assert rows.count() == 0 and [(r.channel, r.ok, r.rows) for r in status.collect()] == [("a", False, 0), ("b", False, 0)]


def test_parts_of_the_index_grow_with_the_texts(spark, monkeypatch):
    from docketry.operators import fulltext

    monkeypatch.setattr(fulltext, "PART_BYTES", 2000)
    docs = spark.range(400).select(F.format_string("C%06d", "id").alias("case_id"), F.concat_ws(" ", F.lit("the"), F.format_string("w%d", F.col("id") % 97), F.format_string("v%d", "id"), F.lit("x" * 480)).alias("text"))
    index = fulltext.FullTextIndex.over(docs)
    folder = spark.read.parquet(index.path + "/postings/batch=0").withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in folder.groupBy("file").count().collect()]
    # 400 texts of 500 bytes are 100 parts: 32 folders of 4 slices.  No file holds a frequent token's list whole.
    assert len(sizes) > 100 and max(sizes) < 400
    assert folder.where("token = 'the'").count() == 400 and folder.where("token = 'the'").select("file").distinct().count() == 4
    assert index.containing("the w5").count() == docs.where("id % 97 = 5").count()
