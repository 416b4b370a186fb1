"""The five tasks as plans: ingest, tag, retrieve, review, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import classify, refine, retrieval, review
from docketry.operators.fulltext import FullTextIndex
from docketry.operators.metrics import ranking_metrics


def tagged(cases: DataFrame) -> DataFrame:
    """Cases (party_name, violation_behavior, legal_basis) with scores, tags and ids."""
    scores = classify.dictionary_scores(F.col("party_name"), F.col("violation_behavior"), F.col("legal_basis"))
    scored = cases.select("*", *[c.alias(n) for n, c in scores.items()], classify.predict_tags(F.coalesce("violation_behavior", F.lit(""))).alias("predicted"))
    out = refine.refined(scored, "predicted", "violation_behavior", "risk_tags").drop("predicted")
    return out.withColumn("risk_type_ids", classify.tags_to_ids(F.col("risk_tags")))


def retrieved(queries: DataFrame, index: FullTextIndex, postings: DataFrame, query_postings: DataFrame, k: int = 10) -> DataFrame:
    """Lexical and sparse channels of (qid, text), fused."""
    lex = retrieval.lexical(queries, index, retrieval.DEPTH["bm25"]).select("qid", F.lit("bm25").alias("channel"), "case_id", "score", "rk")
    spa = retrieval.sparse(query_postings, postings, retrieval.DEPTH["sparse"]).select("qid", F.lit("sparse").alias("channel"), "case_id", "score", "rk")
    return retrieval.rrf(lex.unionByName(spa), k)


def reviewed(materials: DataFrame, key: str, text: str, strict) -> DataFrame:
    """One row per material: risky sentences, their ids and the overall risk."""
    found = review.risk_sentences(review.sentences(materials, key, text), strict)
    per = found.groupBy(key).agg(
        F.count("*").alias("n_risky"), F.max(review.severity_rank(F.col("severity"))).alias("_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("risk_ids")))).alias("risk_ids")
    )
    joined = materials.select(key).join(per, key, "left")
    return joined.select(key, F.coalesce("n_risky", F.lit(0)).alias("n_risky"), "risk_ids", review.overall(F.col("_rank")).alias("overall_risk"))


def evaluated(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    return ranking_metrics(ranked, gold, k)
