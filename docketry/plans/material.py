"""Review of material sentence by sentence: each different sentence is looked up once, and what it found goes to all its places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.storage import stored

# Fixed value: cases of a sentence.
SENTENCE_CASES = 5


def first_sentences(sentences: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows (key, pos, sentence, ...) of each material, for callers that want no more; reports are of all."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return sentences.withColumn("place", place).where(F.col("place") <= n).drop("place")


def sentence_cases(sentences: DataFrame, search: Callable[[DataFrame, int], DataFrame], n: int = SENTENCE_CASES) -> DataFrame:
    """``sentences`` with ``cases``: up to ``n`` (score, case_id), best first, and ``hit_score``, the best score (null without cases).

    ``search`` takes (qid, text) and a number, and gives (qid, case_id, score, rk).  Sentences are told apart by the hash of
    their text, so that work is in proportion to the different ones; a sentence that stands in a third of all places is
    found once and joined by a hash whose answer is one row.
    """
    marked = sentences.withColumn("sentence_hash", F.sha2("sentence", 256))
    different = stored(marked.select(F.col("sentence_hash").alias("qid"), F.col("sentence").alias("text")).dropDuplicates(["qid"]), "sentences")
    found = search(different, n).where(F.col("rk") <= n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "case_id", "score")))
    answers = found.groupBy("qid").agg(F.transform(listed, lambda x: F.struct(x["score"].alias("score"), x["case_id"].alias("case_id"))).alias("cases"))
    none = F.array().cast("array<struct<score:double,case_id:string>>")
    out = marked.join(stored(answers, "answers"), F.col("sentence_hash") == F.col("qid"), "left").drop("qid", "sentence_hash")
    return out.withColumn("cases", F.coalesce("cases", none)).withColumn("hit_score", F.try_element_at("cases", F.lit(1))["score"])


def report_rows(reviewed: DataFrame, key: str) -> DataFrame:
    """(key, rk, pos, sentence, hit_score, case_id): sentences of a report, best hit first; those without cases come last."""
    order = Window.partitionBy(key).orderBy(F.col("hit_score").desc_nulls_last(), "pos")
    top = F.try_element_at("cases", F.lit(1))["case_id"]
    return reviewed.select(key, F.row_number().over(order).alias("rk"), "pos", "sentence", "hit_score", top.alias("case_id"))
