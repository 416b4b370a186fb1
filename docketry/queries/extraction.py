"""Whole cases of decision texts and model answers; each text is a heading with a document behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.plans import extraction
from docketry.queries.base import query, table


def _heading(party: Column) -> Column:
    i = F.col("doc_id").cast("string")
    day, fine = ((F.col("doc_id") % 28 + 1).cast("string"), (F.col("doc_id") % 50 + 1).cast("string"))
    lit = F.lit
    return F.concat(
        lit("京金罚决字〔2026〕"), i, lit("号\n"), party, lit("\n行政处罚内容：罚款"), fine, lit("万元\n2026年3月"), day, lit("日\n"), F.coalesce("text", lit(""))
    )


FIRM_SQL = "'第' || doc_id || '人寿保险股份有限公司'"
DATE_SQL = "printf('2026-03-%02d', doc_id % 28 + 1)"
FINE_SQL = "(doc_id % 50 + 1) || '万元'"


def _firm() -> Column:
    return F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("人寿保险股份有限公司"))


@query(f"""select doc_id, case doc_id % 4 when 0 then {FIRM_SQL} || '上海分公司' when 3 then null else {FIRM_SQL} end party_name,
  '京金罚决字〔2026〕' || doc_id || '号' penalty_doc_no, {FINE_SQL} fine_amount, {DATE_SQL} publish_date, '北京银保监局' regulator,
  case doc_id % 4 when 3 then '非保险' else '寿险公司' end institution_type,
  case doc_id % 4 when 2 then 0.67 when 3 then 0.41 else 0.576 end::double overall_confidence, doc_id % 4 <> 2 needs_refine from documents""")
def extract_decisions(spark, sf_dir):
    """Cases of all documents: parties broken across lines, a person before a firm, a firm in a sentence, none at all."""
    kind = F.col("doc_id") % 4
    party = (
        F.when(kind == 0, F.concat(F.lit("当事人：某某，男\n当事人："), _firm(), F.lit("上海\n分公司\n住所：上海")))
        .when(kind == 1, F.concat(F.lit("当事人：张三，男\n当事人："), _firm(), F.lit("，住所的上海")))
        .when(kind == 2, F.concat(F.lit("经查，"), _firm(), F.lit("存在下列问题")))
        .otherwise("无主体")
    )
    d = table(spark, sf_dir, "documents").select("doc_id", _heading(party).alias("decision"))
    out = extraction.from_texts(d, "doc_id", "decision")
    return out.select("doc_id", "party_name", "penalty_doc_no", "fine_amount", "publish_date", "regulator", "institution_type", "overall_confidence", "needs_refine")


@query(f"""with d as (select doc_id, doc_id % 4 k from documents),
x as (select doc_id, k, unnest(case k when 0 then ['甲' || doc_id || '公司', '乙' || doc_id || '公司'] else [{FIRM_SQL}] end) party_name from d)
select doc_id, party_name, case k when 0 then '事实' when 1 then '另一事实' end violation_behavior, case when k < 2 then 'hybrid' else 'regex' end extraction_method,
  case k when 0 then '财险公司' else '寿险公司' end institution_type, case when k = 1 then '3万元' else {FINE_SQL} end fine_amount, {DATE_SQL} publish_date from x""")
def model_cases(spark, sf_dir):
    """Model answers to all documents: two parties in one field, blank ones, text that is no JSON, none."""
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    answer = F.when(
        kind == 0, F.concat(F.lit('```json\n{"cases": [{"party_name": ["甲'), i, F.lit('公司", "乙'), i, F.lit('公司"], "violation_behavior": "事实", "institution_type": "财险公司"}]}\n```'))
    ).when(kind == 1, '{"party_name": "null", "violation_behavior": "另一事实", "penalty_content": "罚款3万元", "institution_type": "保险公司"}').when(kind == 2, "不是 JSON")
    d = table(spark, sf_dir, "documents").select("doc_id", _heading(F.concat(F.lit("当事人："), _firm())).alias("decision"), answer.alias("answer"))
    out = extraction.from_answers(d, "doc_id", "decision", "answer")
    return out.select("doc_id", "party_name", "violation_behavior", "extraction_method", "institution_type", "fine_amount", "publish_date")
