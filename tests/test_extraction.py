"""Parties and whole cases of decision texts."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import parties
from docketry.plans import extraction

DECISION = """行政处罚决定书
鲁金罚决字〔2026〕16号
当事人：华泰人寿保险股份有限公司山东分公司
主要违法违规事实：给予投保人保险合同约定以外的其他利益
行政处罚内容：罚款人民币11.5万元
作出处罚决定的机关名称：国家金融监督管理总局山东监管局
依据《中华人民共和国保险法》第一百六十一条规定
2026年3月3日
"""
UNIT = """中国银保监会广东监管局行政处罚决定书(北京联合保险经纪有限公司广东分公司)

粤银保监罚决字〔2019〕2号

被处罚单位名称:北京联合保险经纪有限公司广东分公司
地          址:广州市越秀区环市东路450号
经查,你公司存在财务数据不真实的行为。
"""
NAMED = """行政处罚决定书
新保监罚〔2018〕23号
      名称:昌吉市庞大一众汽车销售服务有限公司
      营业地址:新疆昌吉市乌伊西路
      经查,你公司存在给予投保人保险合同约定外利益的违法行为。
"""
TWO_PARTIES = """浙保监罚[2007]2号
当事人:顾斌,男,汉族,1963年11月18日出生。
当事人:安邦财产保险股份有限公司台州中心支公司(以下简称安邦产险台州中支),住所的台州市鑫泰广场。
经查,安邦产险台州中支存在以下违法事实。
"""


def cases(spark, *texts):
    return extraction.from_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").orderBy("id", "pos").collect()


def test_whole_decision(spark):
    (c,) = cases(spark, DECISION)
    assert (c.penalty_doc_no, c.party_name, c.publish_date) == ("鲁金罚决字〔2026〕16号", "华泰人寿保险股份有限公司山东分公司", "2026-03-03")
    assert "其他利益" in c.violation_behavior and c.fine_amount == "11.5万元" and "山东监管局" in c.regulator
    assert c.institution_type == "寿险公司" and c.overall_confidence >= 0.75 and not c.needs_refine and c.extraction_method == "regex"


def test_labels_and_persons(spark):
    a, b, c = cases(spark, UNIT, NAMED, TWO_PARTIES)
    assert a.party_name == "北京联合保险经纪有限公司广东分公司" and "庞大一众汽车销售服务有限公司" in b.party_name
    assert "安邦财产保险股份有限公司台州中心支公司" in c.party_name and "顾斌" not in c.party_name


def test_blank_and_poor_texts(spark):
    assert cases(spark, None, "", "  \n") == []
    (c,) = cases(spark, "与处罚无关的一段话。")
    assert c.party_name is None and c.needs_refine and c.overall_confidence == 0.05


@pytest.mark.parametrize(
    ("name", "text", "whole"),
    [
        ("某人寿保险股份有限公司北京", "当事人：某人寿保险股份有限公司北京\n分公司\n住所：x", "某人寿保险股份有限公司北京分公司"),
        ("甲保险（集团", "甲保险（集团\n股份）有限公司", "甲保险（集团股份）"),
        ("甲保险（集团", "甲保险（集团\n股份有限公司", "甲保险（集团"),
        ("张三", "当事人：张三\n住所：北京某某公司", "张三"),
        ("张三", "张三\n职员甲住所", "张三"),
        ("甲公司", "甲公司，\n分公司", "甲公司"),
        ("甲公司", "乙", "甲公司"),
        ("甲", "甲\n" + "乙" * 58 + "公司", "甲"),
        ("", "\n公司", ""),
        (None, "x", None),
    ],
)
def test_repair_across_line_breaks(spark, name, text, whole):
    d = spark.createDataFrame([(name, text)], "n string, t string")
    assert d.select(parties.repaired(F.col("n"), F.col("t")).alias("x")).first().x == whole


def test_records(spark):
    names = "party_name, penalty_doc_no, violation_behavior, penalty_content, regulator, publish_date, legal_basis"
    rows = [("某财产保险股份有限公司北京分公司", "京金罚决字〔2026〕8号", "编制虚假财务资料", "罚款30万元", "国家金融监督管理总局北京监管局", "2026年1月15日", None), (None,) * 7]
    full, empty = extraction.from_records(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split(", ")))).orderBy(F.col("party_name").desc_nulls_last()).collect()
    assert (full.publish_date, full.institution_type, full.extraction_method, full.fine_amount) == ("2026-01-15", "财险公司", "table", "30万元")
    assert empty.overall_confidence == 0.05 and empty.party_name is None and empty.needs_refine


def test_answers(spark):
    answers = [
        (0, DECISION, '```json\n{"cases": [{"party_name": ["甲人寿保险公司", " ", "乙公司", "null"], "violation_behavior": "长事实", "institution_type": "其他"}]}\n```'),
        (1, DECISION, "no json"),
        (2, DECISION, None),
        (3, DECISION, '{"party_name": null, "penalty_content": "null", "regulator": "申请行政复议", "is_insurance_related": false}'),
        (4, DECISION, "[]"),
        (5, " ", '{"party_name": "甲"}'),
    ]
    out = extraction.from_answers(spark.createDataFrame(answers, "id int, text string, answer string"), "id", "text", "answer").orderBy("id", "party_name").collect()
    assert [r.id for r in out] == [0, 0, 1, 2, 3, 4]
    assert [out[0].party_name, out[1].party_name] == ["乙公司", "甲人寿保险公司"] and {r.extraction_method for r in out[:2]} == {"hybrid"}
    assert out[0].violation_behavior == "长事实" and out[0].penalty_doc_no == "鲁金罚决字〔2026〕16号" and out[0].institution_type == "其他"
    assert {r.extraction_method for r in (out[2], out[3], out[5])} == {"regex"} and out[2].party_name.startswith("华泰人寿")
    assert out[4].party_name.startswith("华泰人寿") and out[4].regulator.endswith("山东监管局") and out[4].is_insurance_related is False and out[4].fine_amount == "11.5万元"
