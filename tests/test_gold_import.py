"""Gold records: coalescing documents, overwritten cases, replaced relations, one switch for all."""

import pytest

from docketry.plans.gold_import import GoldTables
from docketry.storage import scratch

RECORDS = "case_id string, file_id string, line int, party_name string, institution_type string, penalty_doc_no string, violation_behavior string, penalty_content string, regulator string, risk_tags array<string>, case_summary string, confidence double"


def record(case, file, line, party=" 平安财产保险股份有限公司 ", regulator="R", violation="虚列费用", tags=("销售误导",), no="", confidence=0.9):
    return (case, file, line, party, "保险公司", no, violation, None, regulator, None if tags is None else list(tags), "s", confidence)


def content(g):
    return {n: sorted(map(repr, g.table(n).collect())) for n in ("documents", "cases", "relations")}


def test_merge_conflicts_and_reruns(spark, monkeypatch):
    g = GoldTables(spark, scratch(spark, "gold"))
    texts = spark.createDataFrame([("F1", "raw one"), ("F2", "")], "file_id string, raw_text string")
    first = spark.createDataFrame([record("C1", "F1", 1), record("C2", "F2", 2, party="", regulator=None), record("C1", "F1", 3, regulator=None, no="N1")], RECORDS)
    assert g.version() is None and g.table("cases").count() == 0 and g.merge(first, texts) and g.version() == 0
    docs = {r.file_id: r for r in g.table("documents").collect()}
    assert (docs["F1"].regulator, docs["F1"].raw_text, docs["F2"].raw_text, docs["F2"].file_name) == ("R", "raw one", None, "F2.txt")
    cases = {r.case_id: r for r in g.table("cases").collect()}
    assert (cases["C1"].penalty_doc_no, cases["C1"].regulator, cases["C1"].party_name) == ("N1", None, "平安财产保险股份有限公司")
    assert (cases["C2"].party_name, cases["C2"].penalty_content, cases["C2"].penalty_doc_no, cases["C2"].risk_type_ids) == ("未知当事人", "见原文", None, ["R001"])
    before = content(g)
    assert not g.merge(first, texts) and g.version() == 0 and content(g) == before
    later = spark.createDataFrame([record("C2", "F1", 1, party="张三", regulator="Q", tags=None), record("C3", "F3", 2)], RECORDS)
    monkeypatch.setattr("docketry.plans.gold_import.commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        g.merge(later, texts.limit(0))
    assert g.version() == 0 and content(g) == before  # nothing of it is seen
    monkeypatch.undo()
    assert g.merge(later, texts.limit(0)) and g.version() == 1
    docs = {r.file_id: r for r in g.table("documents").collect()}
    assert len(docs) == 3 and (docs["F1"].regulator, docs["F1"].raw_text) == ("Q", "raw one")
    relations = {r.case_id: r.entity_type for r in g.table("relations").collect()}
    assert relations == {"C1": "保险公司", "C2": "责任人员", "C3": "保险公司"} and g.table("relations").count() == 3
    cases = {r.case_id: r for r in g.table("cases").collect()}
    assert cases["C2"].file_id == "F1" and cases["C2"].risk_tags == [] and cases["C2"].candidate_reasons == ["competition_gold"]
