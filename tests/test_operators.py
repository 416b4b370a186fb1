"""Golden cases and invariants of the engine's operators."""

import io
import itertools
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions.text import fine_value, parse_date, parties
from docketry.operators import classify, extract, retrieval, review, tables
from docketry.operators.metrics import ranking_metrics
from docketry.queries.documents import TWO
from docketry.queries.evaluation import best_pairs
from docketry.sources import files
from docketry.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rrf_and_cap(spark):
    rows = [("q", "bm25", "C1", 1), ("q", "bm25", "C2", 2), ("q", "vector", "C2", 1), ("q", "vector", "C3", 2)]
    out = retrieval.rrf(spark.createDataFrame(rows, "qid string, channel string, case_id string, rk int"), 10).orderBy("rk").collect()
    assert [r.case_id for r in out][0] == "C2" and out[0].channels == ["bm25", "vector"] and len(out) == 3
    many = spark.createDataFrame([("q", "bm25", f"C{i:02}", i + 1) for i in range(20)], "qid string, channel string, case_id string, rk int")
    assert retrieval.rrf(many, 5).count() == 5 and retrieval.rrf(many.limit(0), 5).count() == 0


def test_sparse_and_upsert(spark):
    docs = spark.createDataFrame([("a", "保险", 1.0), ("a", "误导", 0.5), ("b", "保险", 0.8), ("c", "合同", 1.0)], "case_id string, token string, w double")
    q = spark.createDataFrame([(1, "保险", 1.0), (1, "误导", 1.0)], "qid int, token string, w double")
    assert [(r.case_id, r.score) for r in retrieval.sparse(q, docs, 2).orderBy("rk").collect()] == [("a", 1.5), ("b", 0.8)]
    new = spark.createDataFrame([("a", "合同", 2.0), ("a", "x", 0.0)], docs.schema)
    assert sorted((r.token, r.w) for r in retrieval.upsert_postings(docs, new).where("case_id = 'a'").collect()) == [("合同", 2.0)]


def test_metrics_golden(spark):
    ranked = spark.createDataFrame([("q", "C9", 1), ("q", "C1", 2), ("q", "C2", 3)], "qid string, case_id string, rk int")
    gold = spark.createDataFrame([("q", "C1", 2.0), ("q", "C2", 1.0)], "qid string, case_id string, gain double")
    r = ranking_metrics(ranked, gold, 3).first()
    assert (r.mrr, r.top1, r.recall3) == (0.5, 0.0, 1.0)


def test_text_functions(spark):
    assert one(spark, parties(F.lit("甲、乙；丙"))) == ["甲", "乙", "丙"]
    assert str(one(spark, parse_date(F.lit("2026年4月24日")))) == "2026-04-24" and one(spark, parse_date(F.lit("not-a-date"))) is None
    assert one(spark, fine_value(F.lit("罚款1.5万元"))) == 15000.0 and one(spark, fine_value(F.lit(None).cast("string"))) == 0.0


@pytest.mark.parametrize(("name", "kind"), [("人寿保险股份有限公司北京分公司", "保险分支机构"), ("平安财产保险股份有限公司", "保险公司"), ("某保险代理有限公司", "保险代理中介"), ("张三", "责任人员")])
def test_entity_types(spark, name, kind):
    assert one(spark, classify.entity_type(F.lit(name))) == kind


def test_case_segments(spark):
    got = [r.segment for r in extract.segments(spark.createDataFrame([(1, TWO)], "id int, text string"), "id", "text").orderBy("pos").collect()]
    assert len(got) == 2 and got[0].startswith("京银保监罚〔2026〕1号") and got[1].startswith("当事人：乙保险公司") and "2号" in got[1]


def test_a_number_inside_a_longer_one_keeps_its_place(spark):
    first, second = "京银保监罚〔2026〕12号", "银保监罚〔2026〕1号"
    text = first + "\n当事人：甲保险公司，违法行为：虚列费用若干元并套取资金，予以罚款一万元并警告，内容足够长。\n" + second + "\n当事人：乙保险公司，违法行为：欺骗投保人，予以罚款二万元并警告，内容也足够长，超过四十个字。"
    got = [r.segment for r in extract.segments(spark.createDataFrame([(1, text), (2, "无" * 50), (3, None)], "id int, text string"), "id", "text").orderBy("id", "pos").collect()]
    assert len(got) == 3 and got[0].startswith(first) and "乙保险" not in got[0] and second in got[1] and "甲保险公司，违法" not in got[1].split(second)[1] and got[2] == "无" * 50


def sentences_of(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    return review.sentences(d, "id", "body").orderBy("id", "pos").collect()


def test_sentence_offsets(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("甲乙丙，。！；;:： \n\r1.、（一）#ab") for _ in range(rng.randrange(121))) for _ in range(300)] + ["", None, "\n\n", "甲" * 500 + "\n乙"]
    found = sentences_of(spark, texts)
    for r in found:
        assert "".join(c for c in texts[r.id][r.start : r.end] if c not in "\r\n") == r.sentence
    by = {i: [r for r in found if r.id == i] for i in range(len(texts))}
    for i, rows in by.items():
        assert [r.pos for r in rows] == list(range(len(rows))) and all(a.end <= b.start for a, b in zip(rows, rows[1:]))
        kept = "".join("".join(texts[i][r.start : r.end].split()) for r in rows)
        assert kept == "".join((texts[i] or "").split())  # nothing but white space is left out


def test_sentences_join_soft_lines(spark):
    long = "该公司在销售过程中向投保人承诺给予保险合同约定"
    found = sentences_of(spark, [f"{long}\n以外的利益。第二句！\n\n第三句", "1. 甲\n2. 乙", "\n".join(["字" * 60] * 6)])
    assert [r.sentence for r in found if r.id == 0] == [long + "以外的利益。", "第二句！", "第三句"]
    assert len({r.paragraph for r in found if r.id == 1}) == 2
    assert [len(r.sentence) for r in found if r.id == 2] == [240, 120]  # a block of 220 characters takes no more lines


def test_sentences_are_made_once(spark):
    """No filter makes blocks or pieces again, and the classes with wide characters see only texts that hold one."""
    d = spark.createDataFrame([(1, "甲。乙!丙;？丁\nab! cd;e?\r\nx")], "id int, body string").repartition(2)
    found = review.sentences(d, "id", "body")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and "Filter ((size(" not in plan and plan.count("aggregate(slice(lines") == 2  # of lines to blocks, of breaks
    assert [r.sentence for r in found.orderBy("pos").collect()] == ["甲。", "乙!", "丙;", "？", "丁", "ab!", "cd;", "e?", "x"]


def test_ocr_is_idempotent(spark):
    clean = "当事人：中国人寿保险股份有限公司\n罚款5万元"
    once = one(spark, review.normalize_ocr(F.lit(clean)))
    assert once == clean and one(spark, review.normalize_ocr(F.lit(once))) == once


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=3, max_size=3), min_size=1, max_size=4))
def test_assignment_is_best(rows):
    s = np.array(rows, float)
    best = max(sum(s[i, j] for i, j in zip(p, q)) for k in [min(s.shape)] for p in itertools.permutations(range(s.shape[0]), k) for q in itertools.combinations(range(s.shape[1]), k))
    pairs = best_pairs(s)
    assert sum(s[i, j] for i, j in pairs) == best and len({i for i, _ in pairs}) == len(pairs)


def test_pages_and_filters(spark):
    df = spark.createDataFrame([(f"C{i}", i % 3, i % 2 == 0, i % 5 == 0) for i in range(30)], "case_id string, v int, related boolean, candidate boolean")
    assert tables.page(df, "v", True, 2, 10, "case_id").count() == 10 and tables.page(df, "nope", False, 0, 1000, "case_id").count() == 30
    assert tables.apply_filter(df, tables.CaseFilter(queue="pending")).count() == 3


def test_ids_of_any_type(spark):
    words = [f"w{i * 37 % 101:03}" for i in range(101)]
    existing = spark.createDataFrame([("N000007",), ("X9",), (None,)], "id string")
    for order, kind in (("k", "string"), ("at", "struct<a:int,b:string>")):
        rows = [(w, (i % 5, w)) for i, w in enumerate(words)]
        new = spark.createDataFrame(rows, "k string, at struct<a:int,b:string>").repartition(7)
        got = sorted((r.id, getattr(r, order)) for r in tables.allocate(new, existing, "id", "N", order).collect())
        assert [i for i, _ in got] == [f"N{8 + i:06}" for i in range(101)] and [x for _, x in got] == sorted(x for _, x in got)
    assert tables.allocate(new.limit(0), existing, "id", "N", "k").count() == 0


def test_fines_sort_by_value(spark):
    df = spark.createDataFrame([("a", "5万元"), ("b", "9千元"), ("c", None), ("d", "罚款10万元")], "case_id string, fine_amount string")
    assert [r.case_id for r in tables.page(df, "fine_amount", True, 1, 10, "case_id").collect()] == ["d", "a", "b", "c"]


def test_office_files(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>甲</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(body.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    slide = '<p:sld xmlns:p="p" xmlns:a="a">{}</p:sld>'
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("ppt/slides/slide10.xml", slide.format(shape.format("末页")))
        z.writestr("ppt/slides/slide2.xml", slide.format(""))
        z.writestr("ppt/slides/slide1.xml", slide.format(shape.format("标题") + shape.format("  ") + shape.format("正文")))
    (tmp_path / "c.pptx").write_bytes(body.getvalue())
    got = {r.path[-6:]: r for r in files.office_files(spark, str(tmp_path)).collect()}
    assert got["c.pptx"].text == "## 第1页\n标题\n正文\n\n## 第3页\n末页" and got["c.pptx"].confidence == 0.9
    assert got["a.docx"].text == "甲\n\n乙" and got["b.docx"].error and got["b.docx"].confidence == 0.0


def test_term_lists_and_keywords(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿保险\n#x\n\n人寿保险\n保险\n", "utf-8")
    assert [r.term for r in files.term_list(spark, str(tmp_path / "t.csv")).collect()] == ["人寿保险", "保险"]
    (tmp_path / "k.csv").write_text("risk_tag,keyword\nA,不履行.{0\nA,赠送\n", "utf-8")
    words = [r.pattern for r in files.keyword_table(spark, str(tmp_path / "k.csv")).collect()]
    assert one(spark, F.lit("赠送油卡").rlike(words[1])) is not None and one(spark, F.lit("x").rlike(words[0])) is False


def test_streaming_ingest(spark, tmp_path):
    up, table = tmp_path / "up", str(tmp_path / "table")
    up.mkdir()
    text = "京银保监罚决字〔2026〕12号\n当事人：中国人寿保险股份有限公司\n行政处罚决定：罚款10万元\n2026年3月3日"
    (up / "a.txt").write_text(text, "utf-8")
    (up / "b.txt").write_text(text, "utf-8")
    for _ in range(2):
        ingest.start(spark, str(up), table, str(tmp_path / "check")).awaitTermination()
        (up / "c.txt").write_text(text + " 补充", "utf-8")
    got = spark.read.parquet(table).collect()
    assert sorted(r.file_id for r in got) == ["a.txt", "c.txt"] and got[0].party_name == "中国人寿保险股份有限公司"


def test_cut_fields_are_not_stripped_again(spark, tmp_path):
    from docketry.queries import base, rules
    from tests.compare import connect, same

    # A beginning of 20 characters that ends with a line feed, of 28: at 20 it is no cut, at 19 it would be one.
    texts = [(1, "a" * 19 + "\n" + "b" * 8), (11, "a" * 19 + "\n" + "b" * 9), (21, None), (31, ""), (10, "abc")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(spark, rules.truncations, base.ORACLES["truncations"], str(tmp_path), con)


def test_tag_overlap_matches_each_list_of_tags_once(spark):
    tags = [["a", "b"], ["b", "a", "a"], ["b"], ["c", None], [], None]
    corpus = [(f"C{i:04}", tags[i % 6], float(i % 7) if i % 11 else None) for i in range(1200)] + [("C0000", ["b"], 9.0)]
    queries = [(i, tags[i % 6]) for i in range(0, 300)] + [(0, ["b"])]
    c = spark.createDataFrame(corpus, "case_id string, tags array<string>, confidence double")
    q = spark.createDataFrame(queries, "qid int, tags array<string>")
    found = retrieval.tag_overlap(q, c, 5)
    # All pairs, as a query's rows and a case's rows count together.
    pairs = c.select("case_id", "confidence", F.explode(F.array_distinct("tags")).alias("t")).join(q.select("qid", F.explode(F.array_distinct("tags")).alias("t")), "t")
    pairs = pairs.groupBy("qid", "case_id").agg(F.count("*").cast("double").alias("score"), F.max("confidence").alias("confidence"))
    want = retrieval.top(pairs, 5, F.col("score").desc(), F.col("confidence").desc(), F.col("case_id"))
    names = ["qid", "case_id", "score", "confidence", "rk"]
    assert sorted(map(repr, found.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    # The join on tags is between lists of tags: four of them a side here, however many rows share one.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(tags" in plan and "Generate explode(wanted" in plan


def test_sparse_deals_cases_to_bounded_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(f"C{i:03}", f"t{t}", float(w)) for i in range(300) for t, w in zip(rng.permutation(40)[:8], rng.integers(1, 9, 8))]
    asked = [(q, f"t{t}", 1.0 + q % 3) for q in range(20) for t in rng.permutation(44)[:4]]
    monkeypatch.setattr(retrieval, "SPARSE_PAIRS", 200)
    found = retrieval.sparse(spark.createDataFrame(asked, "qid int, token string, w double"), spark.createDataFrame(docs, "case_id string, token string, w double"), 5)
    scores = {}
    for q, t, a in asked:
        for c, u, b in docs:
            if t == u:
                scores[q, c] = scores.get((q, c), 0.0) + a * b
    want = {(q, c, s, i + 1) for q in range(20) for i, (s, c) in enumerate(sorted(((-s, c) for (p, c), s in scores.items() if p == q))[:5]) for s in [-s]}
    assert {(r.qid, r.case_id, r.score, r.rk) for r in found.collect()} == want
    # One shuffle by case for joining and summing; pairs are not shuffled before the best are taken.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case_id" in plan and "hashpartitioning(qid#" in plan and ", case_id#" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_dense_holds_the_scores_of_a_few_queries_at_once(spark, monkeypatch):
    from docketry.operators.permits import Permit

    # Fewer queries a pass than there are; a wrong slice of the filters or of the scores would show.
    monkeypatch.setattr(retrieval, "SCORED_QUERIES", 4, raising=True)
    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(60, 8)), rng.normal(size=(11, 8))
    corpus = spark.createDataFrame([(f"C{i:02}", v.tolist()) for i, v in enumerate(c)], "case_id string, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist(), "r1" if i % 3 == 0 else None) for i, v in enumerate(q)], "qid int, v array<double>, regulator string")
    cases = spark.createDataFrame([(f"C{i:02}", True, f"r{i % 2}") for i in range(60)], "case_id string, related boolean, regulator string")
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 6)
    for permit in (None, Permit.of(queries, cases)):
        found = {(r.qid, r.case_id) for r in retrieval.dense(queries, corpus, 5, permit=permit).collect()}
        allowed = lambda i, j: permit is None or i % 3 > 0 or j % 2 == 1
        assert found == {(i, f"C{j:02}") for i in range(11) for j in sorted((j for j in range(60) if allowed(i, j)), key=lambda j: (-scores[i, j], j))[:5]}


def test_backend_deals_texts_once_by_case(spark, monkeypatch):
    from docketry.plans import backend

    monkeypatch.setattr(backend, "COUNTED_BYTES", 200)
    corpus = spark.createDataFrame([(f"C{i:02}", f"w{i % 7} w{i % 5} word{i} the the") for i in range(50)] + [("C99", None)], "case_id string, text string")
    queries = spark.createDataFrame([(1, "the w4 word4"), (2, "nothing")], "qid int, text string")
    made = backend.Backend()
    plan = made.channels(queries, corpus)._jdf.queryExecution().executedPlan().toString()
    # The corpus is dealt by case alone, never by case and token or bucket.
    assert "hashpartitioning(case_id" in plan and not re.search(r"hashpartitioning\(case_id#\d+, (token|bucket)", plan)
    best = {(r.qid, r.rk): (r.case_id, r.score) for r in made.retrieve(queries, corpus).collect()}
    assert best[1, 1] == ("C04", 1.0)
