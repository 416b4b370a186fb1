"""Extracted cases against gold cases: optimal pairs within each file, and the metrics over all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.checks import small
from docketry.operators.metrics import field_scores, is_truncated, pair_overlap, plain_field, prf
from docketry.storage import stored

#: Cases of a file, on either side, that are paired in one task.
MAX_CASES = 64
# Fields compared as a whole, by characters, and what they count for in a pair's score.
EXACT = ["party_name", "penalty_doc_no", "regulator", "institution_type"]
LONG = ["violation_behavior", "penalty_content"]
NUMBER_SCORE, PARTY_SCORE, PARTY_PART_SCORE, AUTHORITY_SCORE = 3.0, 3.0, 1.5, 1.0
# Labels before a gold party, values and words that make a gold field noise.
PARTY_LABELS = [
    "被处罚单位名称", "受处罚单位名称", "被处罚人名称", "受处罚人名称", "被处罚当事人", "受处罚当事人", "被处罚单位", "受处罚单位", "当事人单位名称", "当事人名称", "当事人单位",
    "受处罚机构名称", "当事人", "名称",
]
PROCEDURAL = ["依据《", "行政复议", "加处罚款", "根据《", "申请行政", "强制执行", "缴款"]
PLACEHOLDER, SEE_TEXT, DUMP_CHARS = "保险机构", "见原文", 80
PAIR_FIELDS = ["penalty_doc_no", "party_name", "regulator", *LONG]


def best_pairs(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest total score (Hungarian method with potentials); zero scores stay alone."""
    n, m = scores.shape
    if not n or not m:
        return []
    flip = n > m
    cost = -(scores.T if flip else scores)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, used, way = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs if cost[a, b] < 0)


def pair_scores(gold: pd.DataFrame, pred: pd.DataFrame) -> np.ndarray:
    """Score of each gold case (row) with each predicted one (column); fields are plain strings, blank where missing."""
    counted = {(side, f): [Counter(t) for t in d[f]] for side, d in (("g", gold), ("p", pred)) for f in LONG}
    out = np.zeros((len(gold), len(pred)))
    for i, g in enumerate(gold[PAIR_FIELDS].itertuples(index=False)):
        for j, p in enumerate(pred[PAIR_FIELDS].itertuples(index=False)):
            s = NUMBER_SCORE * (g.penalty_doc_no != "" and g.penalty_doc_no == p.penalty_doc_no)
            if g.party_name and p.party_name:
                s += PARTY_SCORE if g.party_name == p.party_name else PARTY_PART_SCORE * (g.party_name in p.party_name or p.party_name in g.party_name)
            s += AUTHORITY_SCORE * (g.regulator != "" and g.regulator == p.regulator)
            for f in LONG:
                n = len(getattr(g, f)) + len(getattr(p, f))
                s += 2 * (counted["g", f][i] & counted["p", f][j]).total() / n if n else 0.0
            out[i, j] = s
    return out


def _paired(file: str):
    def run(gold: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
        g, p = gold.sort_values("gold_id", ignore_index=True), pred.sort_values("pred_id", ignore_index=True)
        pairs = best_pairs(pair_scores(g, p)) if len(g) and len(p) else []
        # Cases that no score joins are paired in order, as far as both sides go: each file pairs as many as it can.
        left, right = sorted(set(range(len(g))) - {i for i, _ in pairs}), sorted(set(range(len(p))) - {j for _, j in pairs})
        rows = [(g[file][i], g["gold_id"][i], p["pred_id"][j]) for i, j in [*pairs, *zip(left, right)]]
        return pd.DataFrame(rows, columns=[file, "gold_id", "pred_id"])

    return run


def _zipped(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th gold case with the n-th predicted one of the same keys, none of them blank."""
    told = " and ".join(f"{k} <> ''" for k in keys[1:])
    side = lambda d, i: d.where(told).select(*keys, i, F.row_number().over(Window.partitionBy(*keys).orderBy(i)).alias("n"))
    return side(gold, "gold_id").join(side(pred, "pred_id"), [*keys, "n"]).select(keys[0], "gold_id", "pred_id")


def matched(gold: DataFrame, pred: DataFrame, file: str, max_cases: int = MAX_CASES) -> DataFrame:
    """(file, gold_id, pred_id): cases paired one to one within their file; the one side of a case without a partner is null.

    ``gold``: (file, gold_id, fields), ``pred``: (file, pred_id, fields); ids are unique.  Files with at most ``max_cases``
    cases on each side get the pairs with the largest total score.  In larger ones, whose scores would grow with the square
    of their cases, the n-th cases of equal number and party are paired, then of equal number, then of equal party.
    A null file is a file of its own.
    """
    plain = lambda d, i: d.select(F.coalesce(F.col(file).cast("string"), F.lit("")).alias(file), i, *[plain_field(F.col(c)).alias(c) for c in PAIR_FIELDS])
    g, p = stored(plain(gold, "gold_id"), "gold"), stored(plain(pred, "pred_id"), "pred")
    sizes = g.select(file, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(p.select(file, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(file).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    big = small(stored(sizes.where((F.col("a") > max_cases) | (F.col("b") > max_cases)).select(file), "big"))
    ids = f"{file} string, gold_id {g.schema['gold_id'].dataType.simpleString()}, pred_id {p.schema['pred_id'].dataType.simpleString()}"
    out = g.join(big, file, "left_anti").groupBy(file).cogroup(p.join(big, file, "left_anti").groupBy(file)).applyInPandas(_paired(file), ids)
    left, right = g.join(big, file, "left_semi").drop(*LONG, "regulator"), p.join(big, file, "left_semi").drop(*LONG, "regulator")
    for keys in ([file, "penalty_doc_no", "party_name"], [file, "penalty_doc_no"], [file, "party_name"]):
        pairs = stored(_zipped(left, right, keys), "pairs")
        left, right, out = left.join(pairs.select("gold_id"), "gold_id", "left_anti"), right.join(pairs.select("pred_id"), "pred_id", "left_anti"), out.unionByName(pairs)
    out = stored(out, "matched")
    lone_gold = g.join(out.select("gold_id"), "gold_id", "left_anti").select(file, "gold_id", F.lit(None).cast(p.schema["pred_id"].dataType).alias("pred_id"))
    lone_pred = p.join(out.select("pred_id"), "pred_id", "left_anti").select(file, F.lit(None).cast(g.schema["gold_id"].dataType).alias("gold_id"), "pred_id")
    return out.unionByName(lone_gold).unionByName(lone_pred)


def side_by_side(pairs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``pairs`` with the fields of both cases, as ``g_<field>`` and ``e_<field>``; fields of a missing side are null."""
    fields = [*EXACT, *LONG, "is_insurance_related"]
    named = lambda d, i, s: d.select(i, *[F.col(c).alias(s + c) for c in fields])
    return pairs.join(named(gold, "gold_id", "g_"), "gold_id", "left").join(named(pred, "pred_id", "e_"), "pred_id", "left")


def _rounded(d: DataFrame, part: str, field: Column, p: Column, r: Column, f1: Column, n: Column, excluded: Column) -> DataFrame:
    long = lambda c: c.cast("long")
    return d.select(F.lit(part).alias("part"), field.alias("field"), *[F.round(c, 4).alias(a) for c, a in ((p, "precision"), (r, "recall"), (f1, "f1"))], long(n).alias("n"), long(excluded).alias("excluded"))


def _long_scores(both: DataFrame, field: str, part: str, noise: Column) -> DataFrame:
    """Means of the character overlap over pairs of which either side is filled; ``n`` of them, ``excluded`` by ``noise``."""
    g, e = plain_field(F.col(f"g_{field}")), plain_field(F.col(f"e_{field}"))
    d = both.select(g.alias("g"), e.alias("e"), noise.alias("noise"))
    d = stored(d, "long")
    scored = pair_overlap(d.where("g <> '' and e <> '' and not noise"), "g", "e").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    n = d.agg(F.count_if(F.expr("(g <> '' or e <> '') and not noise")).alias("n"), F.count_if("noise").alias("x"))
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return _rounded(scored.crossJoin(n), part, F.lit(field), mean("precision"), mean("recall"), mean("f1"), F.col("n"), F.col("x"))  # two single rows


def _adjusted_exact(both: DataFrame, field: str) -> DataFrame:
    raw, e = plain_field(F.col(f"g_{field}")), plain_field(F.col(f"e_{field}"))
    truth = F.regexp_replace(raw, "^(?:" + "|".join(PARTY_LABELS) + r")(?:[:：]|(?=[\s\S]))", "") if field == "party_name" else raw
    d = both.select(raw.alias("raw"), truth.alias("g"), e.alias("e"))
    marked = F.lit(False)
    for word in PROCEDURAL:
        marked = marked | F.contains("raw", F.lit(word))
    noise = (F.col("raw") == PLACEHOLDER) | ((F.col("g") != "") & marked)
    told = (F.col("g") != "") & (F.col("e") != "")
    hit = told & (F.startswith("g", "e") | F.startswith("e", "g"))
    a = d.withColumn("noise", noise).agg(
        F.count_if(~F.col("noise") & hit).alias("tp"), F.count_if(~F.col("noise") & (F.col("e") != "") & ~hit).alias("fp"), F.count_if(~F.col("noise") & (F.col("g") != "") & ~hit).alias("fn"),
        F.count_if("noise").alias("x"), F.count_if(~F.col("noise") & ((F.col("g") != "") | (F.col("e") != ""))).alias("n"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _rounded(a, "adjusted", F.lit(field), p, r, f1, F.col("n"), F.col("x"))


def case_metrics(both: DataFrame) -> DataFrame:
    """(part, field, precision, recall, f1, n, excluded) over cases side by side.

    ``part`` is ``fields`` (exact or by characters; ``n`` pairs with either side filled), ``truncated`` (share of cut long
    fields as precision), ``insurance`` (accuracy of the flag), ``macro`` (mean F1 of all six fields), or ``adjusted``: party,
    number and penalty without gold values that are noise (placeholders, dumped text, legal procedure), a value that begins
    the other counting as right.  Measures that a part lacks are null; without any pair all are 0.
    """
    never, null = F.lit(False), F.lit(None).cast("double")
    filled = lambda f: (plain_field(F.col(f"g_{f}")) != "") | (plain_field(F.col(f"e_{f}")) != "")
    exact = field_scores(both, {f: (f"g_{f}", f"e_{f}") for f in EXACT})
    counts = both.agg(*[F.count_if(filled(f)).alias(f) for f in EXACT]).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in EXACT])))
    parts = counts.join(exact, "field", "left").na.fill(0.0)
    scores = _rounded(parts, "fields", F.col("field"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("n"), F.lit(0))
    for f in LONG:
        scores = scores.unionByName(_long_scores(both, f, "fields", never))
    scores = stored(scores, "scores")
    cut = both.agg(*[F.struct(F.count_if(is_truncated(F.col(f"e_{f}"), F.col(f"g_{f}"))).alias("k"), F.count_if(filled(f)).alias("n")).alias(f) for f in LONG])
    cut = cut.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["k"].alias("k"), F.col(f)["n"].alias("n")) for f in LONG])))
    share = lambda k: F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(0.0)
    flags = F.col("gold_id").isNotNull() & F.col("pred_id").isNotNull() & F.col("g_is_insurance_related").isNotNull()
    right = flags & (F.coalesce("e_is_insurance_related", never) == F.col("g_is_insurance_related"))
    related = both.agg(F.count_if(flags).alias("n"), F.count_if(right).alias("k"))
    macro = scores.agg((F.sum("f1") / (len(EXACT) + len(LONG))).alias("f1"), F.count("*").alias("n"))
    content = plain_field(F.col("g_penalty_content"))
    dumped = content.isin(SEE_TEXT, "") | (F.contains(content, F.lit("当事人")) & (F.length(content) > DUMP_CHARS))
    out = scores.unionByName(_rounded(cut, "truncated", F.col("field"), share("k"), null, null, F.col("n"), F.lit(0)))
    out = out.unionByName(_rounded(related, "insurance", F.lit("is_insurance_related"), share("k"), null, null, F.col("n"), F.lit(0)))
    out = out.unionByName(_rounded(macro, "macro", F.lit("all"), null, null, F.col("f1"), F.col("n"), F.lit(0)))
    for f in ("party_name", "penalty_doc_no"):
        out = out.unionByName(_adjusted_exact(both, f))
    return out.unionByName(_long_scores(both, "penalty_content", "adjusted", dumped))
