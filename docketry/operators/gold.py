"""Cleaning of gold records and merging of field values from patterns and models.

A cleaner is a list of steps over one column.  A step that changes the value notes its reason; a clearing step ends
the cleaning of that value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import U, bound, strip
from docketry.operators.extract import LABELLED_AUTHORITY, PATTERNS

# Label prefixes, placeholders and markers of the fields.
PARTY_LABELS = (
    "被处罚单位名称 受处罚单位名称 被处罚人名称 受处罚人名称 被处罚当事人 受处罚当事人 被处罚单位 受处罚单位 当事人单位名称 当事人名称 当事人单位 受处罚机构名称 "
    "受处罚机构 当事人 名称 姓名"
).split()
PLACEHOLDERS = "保险机构 个人 单位 名称 姓名 当事人".split()
PARTY_PROCEDURAL = "依据《|行政复议|加处罚款|根据《|申请行政|强制执行|缴款|划款凭证|逾期|提起诉讼"
TITLES = "行政处罚决定书|行政处罚信息公开表|行政处罚信息"
AUTHORITY = "中国保险监督管理委员会|国家金融监督管理总局|中国银保监会|中国保监会|[一-鿿]{0,8}(?:银保监局|保监局|监管分局|监管局)"
INSTITUTION = "(?:保险|人寿|财险|产险|经纪|代理|公估|健康保险|养老保险).{0,40}?(?:公司|支公司|分公司|中心支公司|营业部|服务部|电销中心)"
AUTHORITY_LABELS = "作出处罚决定的机关名称 处罚机关 决定机关 名称".split()
BEHAVIOUR_LABELS = "主要违法违规事实（案由） 主要违法违规事实(案由) 主要违法违规事实 主要违法违规行为 违法违规事实 违法违规行为 违法事实 违法行为 违规事实 违规行为".split()
BEHAVIOUR_PROCEDURAL = "证据证明[,，]足以认定|足以认定。|如不服本处罚决定|如不服本决定|申请行政复议|提起行政诉讼|提起诉讼"
DOC_NO_CORE = (
    r"([一-鿿]{0,12}(?:金监罚决字|金罚决字|罚决字|银保监罚决字|银保监罚|保监罚决字|保监罚|保监罚字|罚字)[〔\[（(]\d{4}[〕\]）)]\s*第?\s*\d+\s*号)"
)


@dataclass(frozen=True)
class Step:
    """``change`` gives the new value of a column; with ``final`` a changed value is not looked at any further."""

    reason: str
    change: Callable[[Column], Column]
    final: bool = False


def without_label(labels: list[str]) -> Callable[[Column], Column]:
    """The longest label at the start and the separators after it go, unless nothing would be left."""
    longest = "|".join(f"\\Q{x}\\E" for x in sorted(labels, key=len, reverse=True))

    def change(c: Column) -> Column:
        rest = F.regexp_replace(c, rf"^(?:{longest})[ ：:\t　]*", "")
        return F.when(rest == "", c).otherwise(rest)

    return change


def cleared(condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.when(condition(c), F.lit("")).otherwise(c)


def replaced(pattern: str, by: str = "") -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, U + pattern, by)


def _titled(c: Column) -> Column:
    inside = F.regexp_extract(c, r"[（(]([^（()）]{4,60})[）)]", 1)
    return F.when(c.rlike(TITLES), F.when(inside.rlike(INSTITUTION), inside).otherwise("")).otherwise(c)


def _closed(c: Column) -> Column:
    """Closing brackets without an opening one go; an unclosed bracket is closed if it holds words, else cut off."""
    opened, shut = F.regexp_count(c, F.lit("[（(]")), F.regexp_count(c, F.lit("[）)]"))
    tail = F.regexp_extract(c, r"[（(]([^（()）]*)$", 1)
    unclosed = F.when(F.length(tail) >= 4, F.concat(c, F.lit("）"))).otherwise(F.regexp_replace(c, r"[（(][^（()）]*$", ""))
    return F.when(opened < shut, F.regexp_replace(c, r"[）)]+$", "")).when(opened > shut, unclosed).otherwise(c)


CLEANERS = {
    "party_name": [
        Step("party_placeholder_cleared", cleared(lambda c: c.isin(*PLACEHOLDERS)), True),
        Step("party_label_prefix_stripped", without_label(PARTY_LABELS)),
        Step("party_title", _titled),
        Step("party_regulator_as_party_cleared", cleared(lambda c: c.rlike(AUTHORITY) & ~c.rlike(INSTITUTION)), True),
        Step("party_leading_num_stripped", replaced(r"^[一二三四五六七八九十\d]+[、．.]\s*")),
        Step("party_multi_party_truncated", replaced(r"(?<=^.{4,200}?)\s*[二三四五六七八九十\d]+[、．.][\s\S]*$")),
        Step("party_address_tail_stripped", lambda c: strip(F.regexp_replace(c, r"(?<=^.{2,200}?)[ ，,、]*(?:住所|营业地址|住址|地址|身份证号|职务)[\s\S]*$", ""))),
        Step("party_whitespace_collapsed", replaced(r"\s+")),
        Step("party_paren_fixed", _closed),
        Step("party_procedural_cleared", cleared(lambda c: c.rlike(PARTY_PROCEDURAL) | (F.length(c) > 80)), True),
        Step("party_normalized", replaced(r"^[ ：:\t　，,、]+|[ ：:\t　，,、]+$")),
    ],
    "penalty_doc_no": [
        Step("doc_no_core_extracted", lambda c: F.when(c.rlike(DOC_NO_CORE), F.regexp_replace(F.regexp_extract(c, DOC_NO_CORE, 1), r"(?U)\s+", "")).otherwise(c), True),
        Step("doc_no_tail_stripped", replaced(r"(?:被处罚当事人|被处罚人|受处罚人|当事人|姓名或名称).*$")),
    ],
    "regulator": [
        Step("regulator_label_stripped", without_label(AUTHORITY_LABELS)),
        Step("regulator_procedural_cleared", cleared(lambda c: c.rlike("申请行政复议|提起诉讼|强制执行")), True),
        Step("regulator_truncated_completed", replaced(r"^(国家金融监督管理总局[一-鿿]{1,8}监管)$|^(.*监管分)$", "$1$2局")),
    ],
    "violation_behavior": [
        Step("violation_procedural_cleared", cleared(lambda c: c.rlike(BEHAVIOUR_PROCEDURAL)), True),
        Step("violation_label_stripped", without_label(BEHAVIOUR_LABELS)),
        Step("violation_whitespace_collapsed", replaced(r"\s+")),
    ],
}


def cleaned(df: DataFrame, column: str, steps: list[Step] | None = None) -> DataFrame:
    """``df`` with the column cleaned and ``<column>_reasons``: what was done to it, in order."""
    reasons = f"{column}_reasons"
    state = F.struct(strip(F.coalesce(column, F.lit(""))).alias("v"), F.array().cast("array<string>").alias("r"), F.lit(False).alias("done"))
    df = df.withColumn("_s", state)
    for step in CLEANERS[column] if steps is None else steps:
        df = df.withColumn("_new", step.change(F.col("_s.v")))
        changed = ~F.col("_s.done") & (F.col("_new") != F.col("_s.v"))
        df = df.withColumn(
            "_s",
            F.when(changed, F.struct(F.col("_new").alias("v"), F.array_append("_s.r", F.lit(step.reason)).alias("r"), F.lit(step.final).alias("done"))).otherwise(F.col("_s")),
        )
    return df.withColumn(column, F.col("_s.v")).withColumn(reasons, F.col("_s.r")).drop("_s", "_new")


def clean_report(df: DataFrame) -> DataFrame:
    """How often each reason occurs over all cleaned columns."""
    columns = [c for c in df.columns if c.endswith("_reasons")]
    return df.select(F.explode(F.concat(*columns)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def filled_from(df: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank fields take the value found in the raw text of the same key."""
    f = found.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(f, key, "left")
    return joined.select(*[F.when(F.coalesce(c, F.lit("")) == "", F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def merged_fields(model: dict[str, tuple[Column, Column]], pattern: dict[str, tuple[Column, Column]]) -> tuple[dict[str, tuple[Column, Column]], Column]:
    """Short fields of a case from model and patterns, each (value, level), and whether anything changed.

    Number and authority prefer the pattern unless its level is low and the model has something better; the party only
    fills what is blank or low.
    """
    out, changes = {}, []
    for name, (value, level) in model.items():
        if name not in pattern:
            out[name] = (value, level)
            continue
        other, other_level = pattern[name]
        blank = (F.coalesce(strip(value), F.lit("")) == "") | (F.coalesce(level, F.lit("low")) == "low")
        has = F.coalesce(strip(other), F.lit("")) != ""
        use = has & (blank if name == "party_name" else blank | (F.coalesce(other_level, F.lit("medium")) != "low"))
        out[name] = (F.when(use, strip(other)).otherwise(value), F.when(use, other_level).otherwise(level))
        changes.append(use & (F.coalesce(strip(value), F.lit("")) != strip(other)))
    changed = F.lit(False)
    for c in changes:
        changed = changed | c
    return out, changed


def evidence(text: Column, limit: int = 1800) -> Column:
    """The head, the surroundings of each field found, and the tail of a text, each once, up to ``limit`` characters."""
    def around(pattern: str) -> Column:
        def cut(x: Column) -> Column:
            start = F.greatest(F.lit(1), x["at"] - 48)
            return F.when(x["hit"] != "", F.substr(text, start, x["at"] - start + F.length(x["hit"]) + 160))

        placed = bound(F.regexp_extract(text, U + pattern, 0), lambda hit: F.struct(hit.alias("hit"), F.instr(text, hit).alias("at")))
        return bound(placed, cut)

    chunks = [F.substring(text, 1, 280), *[around(PATTERNS[n][0]) for n in ("penalty_doc_no", "party_name", "violation_behavior", "penalty_content")], around(LABELLED_AUTHORITY), around(PATTERNS["legal_basis"][0])]
    chunks.append(F.when(F.length(text) > 400, F.substr(text, F.length(text) - 399, F.lit(400))))
    kept = F.filter(F.transform(F.array(*chunks), strip), lambda c: c.isNotNull() & (c != ""))
    return F.substring(F.array_join(F.array_distinct(kept), "\n…\n"), 1, limit)
