"""Evaluation metrics as aggregates."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gains of relevance grades.
GAINS = {"strong": 2.0, "medium": 1.0, "weak": 0.5}


def gain(grade: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GAINS.items() for x in kv]), grade), F.lit(1.0))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query of ``gold`` (qid, case_id, gain): mrr, top1, recall3, recall10, ndcg at k of ``ranked`` (qid, case_id, rk)."""
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("gain").desc(), "case_id"))
    ideal = gold.withColumn("i", ideal_rank).groupBy("qid").agg(
        F.count("*").alias("n_rel"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1.0))).alias("ideal")
    )
    hit = ranked.join(gold, ["qid", "case_id"]).groupBy("qid").agg(
        F.min("rk").alias("first"),
        F.count_if(F.col("rk") <= 3).alias("hit3"),
        F.count_if(F.col("rk") <= 10).alias("hit10"),
        F.sum(F.when(F.col("rk") <= k, F.col("gain") / F.log2(F.col("rk") + 1.0))).alias("dcg"),
    )
    zero = F.lit(0.0)
    return ideal.join(hit, "qid", "left").select(
        "qid",
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce((F.col("first") == 1).cast("double"), zero).alias("top1"),
        F.coalesce(F.col("hit3") / F.col("n_rel"), zero).alias("recall3"),
        F.coalesce(F.col("hit10") / F.col("n_rel"), zero).alias("recall10"),
        F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
    )


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_overlap(pairs: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Multiset overlap of characters: (key, precision, recall, f1)."""
    def counted(c: str, name: str) -> DataFrame:
        chars = pairs.select(key, F.explode(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", ""), "")).alias("ch")).where("ch <> ''")
        return chars.groupBy(key, "ch").agg(F.count("*").alias(name))

    both = counted(gold, "g").join(counted(pred, "p"), [key, "ch"], "full").na.fill(0)
    sums = both.groupBy(key).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    p, r, f1 = prf(F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp"))
    return sums.select(key, p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def shared_chars(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Characters that two texts share, repeated ones as often as both hold them, and the characters of each."""
    shared = [(Counter(g) & Counter(p)).total() for g, p in zip(gold, pred)]
    return pd.DataFrame({"tp": shared, "g": [len(g) for g in gold], "p": [len(p) for p in pred]}, dtype="int64")


def pair_overlap(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of :func:`char_overlap` for each row by itself: long texts are counted where they are."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "")
    told = pairs.select(plain(F.col(gold)).alias("g"), plain(F.col(pred)).alias("p")).where("g <> '' or p <> ''")
    counted = F.pandas_udf(shared_chars, "tp long, g long, p long")
    sums = told.select(counted("g", "p").alias("n")).select("n.*")
    p, r, f1 = prf(F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp"))
    return sums.select(p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def label_judge(judged: DataFrame, key: str) -> DataFrame:
    """Per case precision, recall, F1 and full acceptance of (key, side, score), side 'pred' or 'gold', score 0 or 1.

    Without predictions, precision is 1 if there is nothing to predict, else 0; the same holds for recall.
    """
    side = lambda s: F.col("side") == s
    n = judged.groupBy(key).agg(
        F.count_if(side("pred")).alias("n_pred"), F.count_if(side("gold")).alias("n_gold"),
        F.coalesce(F.sum(F.when(side("pred"), F.col("score"))), F.lit(0)).alias("ok_pred"), F.coalesce(F.sum(F.when(side("gold"), F.col("score"))), F.lit(0)).alias("ok_gold"),
    )
    p = F.when(F.col("n_pred") > 0, F.col("ok_pred") / F.col("n_pred")).otherwise((F.col("n_gold") == 0).cast("double"))
    r = F.when(F.col("n_gold") > 0, F.col("ok_gold") / F.col("n_gold")).otherwise((F.col("n_pred") == 0).cast("double"))
    all_pred, all_gold = (F.col("n_pred") > 0) & (F.col("ok_pred") == F.col("n_pred")), (F.col("n_gold") > 0) & (F.col("ok_gold") == F.col("n_gold"))
    full = (all_pred & all_gold) | ((F.col("n_pred") == 0) & (F.col("n_gold") == 0))
    return n.select(key, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), full.alias("full_accept"))


def plain_field(c: Column) -> Column:
    """A field for exact comparison: no blanks, one kind of brackets."""
    return F.translate(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$| ", ""), "[]()", "〔〕（）")


def field_scores(pairs: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of each field (gold column, predicted column), in one pass.

    Two different values are a false positive and a false negative at once.
    """
    marks = []
    for name, (gold, pred) in fields.items():
        g, p = plain_field(F.col(gold)), plain_field(F.col(pred))
        hit = (g != "") & (g == p)
        marks.append(F.struct(F.lit(name).alias("field"), hit.alias("tp"), ((p != "") & ~hit).alias("fp"), ((g != "") & ~hit).alias("fn")))
    n = pairs.select(F.inline(F.array(*marks))).groupBy("field").agg(*[F.count_if(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("field", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


# Fixed value: a prediction shorter than this share of the truth that it is part of is cut off.
TRUNCATED_BELOW = 0.7


def is_truncated(pred: Column, truth: Column) -> Column:
    return is_cut(plain_field(pred), plain_field(truth))


def is_cut(p: Column, t: Column) -> Column:
    """Whether one plain field is a cut off part of another; what is plain is not stripped again."""
    return (p != "") & (t != "") & (p != t) & F.contains(t, p) & (F.length(p) < TRUNCATED_BELOW * F.length(t))


#: Key words that a dictionary may hold; each is an expression of the plan.
MAX_KEYWORDS = 5000


def keyword_scores(texts: DataFrame, key: str, tags: str, keywords: DataFrame) -> DataFrame:
    """(tp, fp, fn) of tags against the tags whose literal key words (tag, keyword) occur in a text: (key, text, tags)."""
    words = [(r.tag, r.keyword) for r in keywords.select("tag", "keyword").limit(MAX_KEYWORDS + 1).collect()]
    if len(words) > MAX_KEYWORDS:
        raise ValueError(f"a dictionary of more than {MAX_KEYWORDS} key words")
    said = F.array_distinct(F.filter(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(t)) for t, w in sorted(words)], F.lit(None).cast("string")), lambda x: x.isNotNull()))
    d = texts.select(key, F.array_distinct(F.col(tags)).alias("gold"), said.alias("said"))
    return d.agg(
        F.sum(F.size(F.array_intersect("gold", "said"))).alias("tp"), F.sum(F.size(F.array_except("said", "gold"))).alias("fp"), F.sum(F.size(F.array_except("gold", "said"))).alias("fn")
    )
