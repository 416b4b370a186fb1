"""Presentation analytics: relevance and confidence for display, ages, highlights, snippets, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import clip, hits, strip

# Bounds of the tiers, and the numbers that words of confidence stand for.
RELEVANCE = ((70.0, "高度相关"), (45.0, "相关"))
CONFIDENCE = ((0.85, "high"), (0.6, "mid"))
WORDS = {"high": 0.95, "medium": 0.75, "mid": 0.75, "low": 0.45}


def relevance_percent(score: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score * 100)), 1)


def relevance_tier(score: Column) -> Column:
    p = relevance_percent(score)
    return F.when(p >= RELEVANCE[0][0], RELEVANCE[0][1]).when(p >= RELEVANCE[1][0], RELEVANCE[1][1]).otherwise("一般相关")


def normal_confidence(c: Column) -> Column:
    """0 to 1 from a number, a percentage or a word; anything else is null."""
    word = F.lower(strip(c))
    n = F.replace(word, F.lit("%"), F.lit("")).try_cast("double")
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), word)
    return F.coalesce(named, F.when(n > 1, F.least(n / 100, F.lit(1.0))).when(n.isNotNull(), F.greatest(F.lit(0.0), n)))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= CONFIDENCE[0][0], CONFIDENCE[0][1]).when(c >= CONFIDENCE[1][0], CONFIDENCE[1][1]).otherwise("low")


# Fixed values: (pattern, label) of scenes, of kinds of behaviour and of risks; the pool of key words; set phrases that say nothing.
SCENES = [
    ("营销|宣传|话术|推介|礼品|奖品|赠送", "保险销售宣传"), ("培训|说明会", "培训与说明材料"), ("合同|条款|投保", "销售签约场景"), ("费用|财务|中介", "费用与财务场景"),
]
BEHAVIOURS = [
    ("礼品|奖品|赠送|领取|体检卡|加油卡", "买即送礼 / 额外赠送"), ("保本|保收益|收益稳定|无风险|稳赚", "承诺收益 / 无风险表述"), ("夸大|虚假|隐瞒", "夸大或隐瞒重要信息"), ("返佣|补贴|费用", "费用或利益输送"),
]
RISKS = [("保本|保收益|收益稳定|无风险", "承诺收益 / 无风险"), ("礼品|奖品|赠送", "合同外利益输送"), ("虚假|夸大|误导", "虚假宣传 / 销售误导")]
POOL = ["保本", "保收益", "无风险", "赠送", "礼品", "奖品", "返佣", "补贴", "夸大", "虚假", "误导", "体检卡", "加油卡", "收益稳定", "稳赚", "合同约定以外", "其他利益"]
SET_PHRASES = "行为目的一致|业务场景一致|高度近似|多路召回交叉验证"
NO_SCENE, NO_BEHAVIOUR, NO_RISK, NO_PENALTY = "业务合规审查场景", "语义行为特征", "待解析风险表述", "暂无处罚结果摘要"
NO_DIFFERENCE = "匹配基于语义与风险标签，请结合原文复核差异点。"
DIFFERENCE = ("查询含「", "」，案例多用近义监管表述（如合同约定以外的利益），属部分匹配而非逐字命中。")


def _labels(text: Column, hints: list[tuple[str, str]]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in hints]), lambda x: x.isNotNull())


def risk_keywords(text: Column, most: int = 4) -> Column:
    """Words of the pool that occur; with fewer than two, the short pieces of the text as well."""
    found = hits(text, POOL)
    pieces = F.filter(F.transform(F.split(text, r"[，。；、！？\s]+"), strip), lambda p: (F.length(p) >= 2) & (F.length(p) <= 8))
    return F.slice(F.when(F.size(found) >= 2, found).otherwise(F.array_distinct(F.concat(found, pieces))), 1, most)


def business_scene(text: Column) -> Column:
    return F.coalesce(F.try_element_at(_labels(text, SCENES), F.lit(1)), F.lit(NO_SCENE))


def behaviour_elements(text: Column) -> Column:
    """Up to three kinds of behaviour, else two key words, else one label for none."""
    kinds, words = F.slice(_labels(text, BEHAVIOURS), 1, 3), risk_keywords(text, 2)
    return F.when(F.size(kinds) > 0, kinds).when(F.size(words) > 0, words).otherwise(F.array(F.lit(NO_BEHAVIOUR)))


def risk_description(text: Column) -> Column:
    words = risk_keywords(text, 2)
    return F.coalesce(F.try_element_at(_labels(text, RISKS), F.lit(1)), F.when(F.size(words) > 0, F.array_join(words, " / ")), F.lit(NO_RISK))


def match_facts(reason: Column) -> Column:
    """Facts of a reason, without set phrases and pieces of fewer than four characters; six at most."""
    plain = strip(F.regexp_replace(F.coalesce(reason, F.lit("")), SET_PHRASES, ""))
    return F.slice(F.filter(F.transform(F.split(plain, "[；;。]"), strip), lambda x: F.length(x) >= 4), 1, 6)


def _first_said(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(F.coalesce(t, F.lit(""))), F.lit("")) for t in texts])


def penalty_highlight(penalty: Column, behaviour: Column) -> Column:
    return F.coalesce(_first_said(penalty, behaviour), F.lit(NO_PENALTY))


def case_headline(*texts: Column, most: int = 52) -> Column:
    """First clause of the first text that says something."""
    said = _first_said(*texts)
    clause = strip(F.split(said, "[。；;\n]", 2)[0])
    return clip(F.when(clause == "", said).otherwise(clause), most)


def missed_keywords(text: Column, corpus: Column) -> Column:
    """Up to three key words of a query that a case does not hold."""
    return F.slice(F.filter(risk_keywords(text, 6), lambda k: ~F.contains(corpus, k)), 1, 3)


def difference_note(text: Column, corpus: Column, reason: Column) -> Column:
    missed = missed_keywords(text, corpus)
    note = F.concat(F.lit(DIFFERENCE[0]), F.array_join(missed, "、"), F.lit(DIFFERENCE[1]))
    return F.when(F.size(missed) > 0, note).otherwise(F.coalesce(F.try_element_at(match_facts(reason), F.lit(1)), F.lit(NO_DIFFERENCE)))


def highlighted(text: Column, terms: list[str]) -> Column:
    """array<struct<text, hit>>: the text cut at its hits, at each place the longest term of two characters or more."""
    usable = sorted({t for t in terms if t and len(t) >= 2}, key=lambda t: (-len(t), t))
    if not usable:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    hit = F.lit("|".join("\\Q" + t + "\\E" for t in usable))
    gaps, found = F.split(text, "|".join("\\Q" + t + "\\E" for t in usable), -1), F.regexp_extract_all(text, hit, F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("found"))
    parts = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(p["gap"].alias("text"), F.lit(False).alias("hit")), F.struct(p["found"].alias("text"), F.lit(True).alias("hit")))))
    return F.filter(parts, lambda p: F.coalesce(p["text"] != "", F.lit(False)))


def age_bucket(minutes: Column) -> Column:
    return F.when(minutes < 1, "now").when(minutes < 60, "minutes").when(minutes < 1440, "hours").when(minutes < 2880, "yesterday").when(minutes < 10080, "days").otherwise("date")


def marked(text: Column, term: Column) -> Column:
    """Every occurrence of a literal term in marks."""
    return F.replace(text, term, F.concat(F.lit("<mark>"), term, F.lit("</mark>")))


def snippet(text: Column, term: Column, radius: int = 28) -> Column:
    """The first occurrence of a term with what surrounds it, ellipses where it is cut; null without one."""
    at = F.instr(text, term)
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text), at + F.length(term) - 1 + radius)
    body = F.substr(text, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise("")))


def atlas(counts: DataFrame, parent: str, child: str, n: str) -> DataFrame:
    """Children with their parent's total, the largest count of the parent, and a bubble size by square root."""
    w = Window.partitionBy(parent)
    total, most = F.sum(n).over(w), F.max(n).over(w)
    return counts.select(parent, child, n, total.alias("total"), F.round(F.sqrt(F.col(n) / F.greatest(most, F.lit(1))), 6).alias("size"))
