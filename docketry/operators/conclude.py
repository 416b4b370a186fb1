"""What follows from retrieved cases: conclusions without a model, traceability, judgements, matches of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import squeeze, strip

# What is said where no model answers.
NO_CASES = "未检索到相似处罚案例，无法给出基于案例的审查意见，建议人工复核。"
NO_MODEL = "LLM 服务暂不可用，以下为四路检索直接返回的相似案例，请人工判断合规风险。"
ADVICE = "建议删除或改写待审查语句中可能构成销售误导、收益承诺或合同外利益的表述，并完整披露风险与除外责任。"
MATERIAL_ADVICE = "请针对材料中已标红的风险语句删除或改写违规表述，完整披露风险与除外责任，不以合同外利益诱导投保。"


def conclusions(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Per query of ``queries`` (qid): the first three tags of its ranked cases (qid, rk, case_id, tags), the first five cases, fixed texts."""
    ranked = F.array_sort(F.collect_list(F.struct("rk", "case_id", "tags")))
    per = cases.groupBy("qid").agg(ranked.alias("found"))
    joined = queries.select("qid").join(per, "qid", "left")
    none = F.col("found").isNull()
    tags = F.slice(F.array_distinct(F.flatten(F.transform("found", lambda c: c["tags"]))), 1, 3)
    return joined.select(
        "qid",
        F.coalesce(tags, F.array().cast("array<string>")).alias("risk_types"),
        F.coalesce(F.slice(F.transform("found", lambda c: c["case_id"]), 1, 5), F.array().cast("array<string>")).alias("case_ids"),
        F.when(none, NO_CASES).otherwise(NO_MODEL).alias("reason"),
        F.when(none, "").otherwise(ADVICE).alias("suggestion"),
        F.when(none, 0.0).otherwise(0.3).alias("confidence"),
    )


def traceable(analysis: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of an analysis whose case was retrieved for its query."""
    return analysis.join(cases.select("qid", "case_id").distinct(), ["qid", "case_id"], "left_semi")


def material_advice(suggestions: Column) -> Column:
    """Distinct suggestions in order, numbered; a fixed text if there is none."""
    kept = F.array_distinct(F.filter(F.transform(suggestions, strip), lambda s: s.isNotNull() & (s != "")))
    lines = F.transform(kept, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.when(F.size(kept) > 0, F.array_join(lines, "\n")).otherwise(MATERIAL_ADVICE)


def case_context(case_id: Column, labelled: dict[str, Column]) -> Column:
    """A case as labelled lines; blanks are N/A."""
    lines = [F.concat(F.lit(f"  {name}："), F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))) for name, c in labelled.items()]
    return F.concat_ws("\n", F.concat(F.lit("[案例 "), case_id, F.lit("]")), *lines)


def judged(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, case_id, rk, score): binary judgement of each expected case; what was not answered is 0, the last answer counts."""
    last = F.row_number().over(Window.partitionBy("qid", "case_id").orderBy(F.col("pos").desc())) == 1
    given = answers.withColumn("_last", last).where("_last").select("qid", "case_id", (F.coalesce(F.col("raw").try_cast("int"), F.lit(0)) >= 1).cast("int").alias("score"))
    return expected.join(given, ["qid", "case_id"], "left").select("qid", "case_id", "rk", F.coalesce("score", F.lit(0)).alias("score"))


def judge_summary(scores: DataFrame) -> DataFrame:
    """Per query: share of relevant cases, any hit, reciprocal rank of the first."""
    return scores.groupBy("qid").agg(
        F.round(F.avg("score"), 6).alias("relevant_rate"), F.max("score").alias("hit_any"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("score") == 1, F.col("rk"))), F.lit(0.0)), 6).alias("mrr")
    )


def record_score(no: Column, other_no: Column, party: Column, other_party: Column, behaviour: Column, method: Column) -> Column:
    """How well an extracted record fits a stored one: number 10, party 5 or 3, up to 2 for length, 1 for a model's."""
    plain = lambda c: squeeze(F.coalesce(c, F.lit("")), "")
    a, b, p, q = plain(no), plain(other_no), plain(party), plain(other_party)
    by_party = F.when((p == "") | (q == ""), 0.0).when(p == q, 5.0).when(F.contains(p, q) | F.contains(q, p), 3.0).otherwise(0.0)
    return (
        F.when((a != "") & (a == b), 10.0).otherwise(0.0) + by_party
        + F.least(F.lit(2.0), F.length(strip(F.coalesce(behaviour, F.lit("")))) / 200.0) + F.when(method.isin("llm", "hybrid"), 1.0).otherwise(0.0)
    )
