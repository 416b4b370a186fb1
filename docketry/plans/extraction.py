r"""Cases of decision texts: by patterns alone, from table records, or from model answers that patterns mend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.answers import items
from docketry.functions.text import U, any_of, bound, first_group, loose_date, strip
from docketry.operators import extract, parties
from docketry.operators.classify import institution
from docketry.operators.gold import evidence, merged_fields

# Further places of the behaviour and the penalty.
BEHAVIOUR_ALT = r"(?:存在(?:以下|下列)?(?:违法|违规)行为[：:]?\s*|经查[，,]?\s*)(?:([\s\S]{8,1200}?)(?=" + extract.STOP + r")|([\s\S]{8,500}))"
PENALTY_ALT = (
    r"((?:我(?:会|局|处|厅)|本机关|经研究决定|经审议决定)?[^。]{0,20}?(?:决定(?:给予|对)?|给予|处以|责令|作出)[^。]{0,40}?"
    r"(?:罚款|警告|没收违法所得|吊销(?:业务)?许可证|暂停[^。]{0,10}业务|停止接受[^。]{0,30}(?:新)?业务)[^。]{0,120}。?)"
)
#: Words without one of which :data:`PENALTY_ALT` finds nothing; it tries many beginnings at each place of a text.
PENALTY_SIGNS = ["决定", "给予", "处以", "责令", "作出"]
# Fields that a model answers, institution types that its answer settles, the confidence below which a case is refined.
MODEL_FIELDS = ["party_name", "penalty_doc_no", "violation_behavior", "penalty_content", "regulator", "case_summary"]
SETTLED_TYPES = {"寿险公司": "寿险公司", "财险公司": "财险公司", "保险代理": "保险代理", "保险经纪": "保险经纪", "其他": "其他", "其他金融机构": "其他", "保险代理人": "其他", "非保险": "非保险"}
REFINE_BELOW = 0.6
CORE = ["party_name", "violation_behavior", "penalty_content", "regulator"]
FIELDS = list(extract.WEIGHTS)
ITEM = "struct<party_name: string, penalty_doc_no: string, violation_behavior: string, penalty_content: string, regulator: string, case_summary: string, institution_type: string, is_insurance_related: boolean>"


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def by_patterns(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``found``: each field of a case as (v, level), from the text alone.

    Blank fields are null.  Levels are high for labelled fields, medium for other places in the text, low for guesses.
    """
    t = F.col(text)
    d = texts
    plain = extract.fields(t)
    d = d.withColumn("_f", _held(*[c.alias(n) for n, c in plain.items() if n != "party_name"]))
    level = lambda c, found: F.when(c.isNotNull(), found).otherwise("low")
    f = lambda n: F.col("_f")[n]
    d = d.withColumn("_alt", _held(
        F.when(f("violation_behavior").isNull() & any_of(t, ["存在", "经查"]), F.substring(first_group(t, BEHAVIOUR_ALT, 2), 1, 1200)).alias("violation_behavior"),
        F.when(f("penalty_content").isNull() & any_of(t, PENALTY_SIGNS), first_group(t, PENALTY_ALT)).alias("penalty_content"),
    ))
    authority, authority_level = extract.regulator(t, f("penalty_doc_no"))
    best = parties.best(t)
    d = d.withColumn("_a", F.struct(authority.alias("v"), authority_level.alias("level"))).withColumn("_p", _named(best))
    d = d.withColumn("_a", _sane(F.col("_a"), extract.sane_regulator)).withColumn("_p", _sane_party(F.col("_p")))
    # Without a sound labelled party, the other places are asked again.
    other = parties.best(t, labelled=False)
    d = d.withColumn("_p", F.when(_blank(F.col("_p.v")), _sane_party(_named(other))).otherwise(F.col("_p")))
    out = {"party_name": F.col("_p"), "regulator": F.col("_a")}
    for n in ("penalty_doc_no", "fine_amount", "legal_basis"):
        out[n] = F.struct(f(n).alias("v"), level(f(n), "high").alias("level"))
    for n in ("violation_behavior", "penalty_content"):
        alt = F.col("_alt")[n]
        out[n] = F.struct(F.coalesce(f(n), alt).alias("v"), F.when(f(n).isNotNull(), "high").when(alt.isNotNull(), "medium").otherwise("low").alias("level"))
    date = extract.decision_date(t)
    out["publish_date"] = F.struct(date.alias("v"), level(date, "medium").alias("level"))
    return d.withColumn("found", _held(*[out[n].alias(n) for n in FIELDS])).drop("_f", "_alt", "_a", "_p")


def _held(*fields: Column) -> Column:
    """A struct whose fields are computed once: Spark does not put their expressions in place of what is taken from it."""
    return bound(F.struct(*fields), lambda x: x)


def _named(best: Column) -> Column:
    return bound(best, lambda x: F.struct(x["name"].alias("v"), x["level"].alias("level")))


def _sane(x: Column, rule) -> Column:
    """A (v, level) under a rule of :mod:`extract`; the lambda binds it once, so that the rule does not repeat its expression."""
    def ruled(y: Column) -> Column:
        value, bad = rule(y["v"])
        return F.struct(F.nullif(value, F.lit("")).alias("v"), F.when(bad | y["v"].isNull(), "low").otherwise(y["level"]).alias("level"))

    return bound(x, ruled)


def _sane_party(x: Column) -> Column:
    """A party cleaned once more and without what is none."""
    again = bound(x, lambda y: F.struct(parties.candidate(y["v"]).alias("v"), y["level"].alias("level")))
    return _sane(again, extract.sane_party)


def finished(cases: DataFrame, text: str, method: Column, settled: Column | None = None) -> DataFrame:
    """Cases with a struct ``found`` of (v, level): fields as columns, institution type, confidence, whether a model should refine.

    Only cases by patterns or from tables below ``REFINE_BELOW`` are refined; model answers are not asked for again.
    """
    v = lambda n: F.coalesce(F.col("found")[n]["v"], F.lit(""))
    summary = F.coalesce(F.col("case_summary"), F.lit("")) if "case_summary" in cases.columns else F.lit("")
    blob = F.concat_ws(" ", v("party_name"), v("violation_behavior"), summary, bound(F.coalesce(text, F.lit("")), evidence))
    kind = bound(F.struct(blob.alias("text"), v("party_name").alias("name")), lambda x: institution(x["text"], x["name"]))
    d = cases.withColumn("extraction_method", method).withColumn("institution_type", kind if settled is None else F.coalesce(settled, kind))
    levels = {n: F.col("found")[n]["level"] for n in FIELDS}
    d = d.withColumn("overall_confidence", extract.confidence({n: F.col("found")[n]["v"] for n in FIELDS}, levels, F.col("extraction_method")))
    asks = ~F.col("extraction_method").isin("llm", "hybrid") & (F.col("overall_confidence") < REFINE_BELOW)
    return d.select("*", *[F.col("found")[n]["v"].alias(n) for n in FIELDS], asks.alias("needs_refine")).drop("found")


def from_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per case of each text (key, pos, extraction_method, institution_type, overall_confidence, fields, needs_refine).

    A text is cut at its document numbers; one that gives no part of its own is a case as a whole.  Blank texts give none.
    """
    told = texts.where(~_blank(F.col(text)))
    # Only texts with several numbers can be cut; the others need no shuffle.
    several = (F.regexp_count(text, F.lit(U + extract.DOC_NO)) >= 2) & (F.length(strip(F.col(text))) > 40)
    whole = told.where(~several).select(key, F.lit(0).alias("pos"), F.col(text).alias("segment"))
    found = by_patterns(extract.segments(told.where(several), key, text).select(key, "pos", "segment").unionByName(whole), "segment")
    return finished(found, "segment", F.lit("regex")).drop("segment")


def from_records(records: DataFrame) -> DataFrame:
    """``records`` (the columns of :data:`extract.HEADERS`, all strings, and any others) as finished cases."""
    text = lambda n: F.nullif(strip(F.coalesce(n, F.lit(""))), F.lit(""))
    fine = first_group(F.coalesce("penalty_content", F.lit("")), extract.PATTERNS["fine_amount"][0])
    values = {n: text(n) for n in extract.HEADERS} | {"publish_date": loose_date(F.coalesce("publish_date", F.lit(""))), "fine_amount": fine}
    # Fields that the table does not vouch for are of medium level where they are filled.
    level = lambda n: F.when(values[n].isNull(), "low").otherwise("high" if n in CORE else "medium")
    d = records.withColumn("found", _held(*[F.struct(values[n].alias("v"), level(n).alias("level")).alias(n) for n in FIELDS]))
    return finished(d.drop(*FIELDS).withColumn("_text", F.lit("")), "_text", F.lit("table")).drop("_text")


def from_answers(texts: DataFrame, key: str, text: str, answer: str) -> DataFrame:
    """Cases of texts with a model's answers (JSON: a list, ``cases``, or one object), one row for each party.

    Long fields stay as the model gave them; number and authority prefer the pattern, the party is filled where it is blank;
    dates, fines and bases come from patterns.  Texts without a usable answer fall back on patterns.  Columns as
    :func:`from_texts`, with ``case_summary`` and ``is_insurance_related``.
    """
    d = by_patterns(texts.where(~_blank(F.col(text))).select(key, F.col(text).alias("segment"), F.col(answer).alias("_answer")), "segment")
    each = d.select("*", F.posexplode_outer(items(F.col("_answer"), ITEM)).alias("_i", "_item"))
    each = parties.one_party_each(each.withColumn("party_name", F.col("_item.party_name")))
    given = lambda c: F.when(~_blank(c) & (F.lower(strip(c)) != "null"), strip(c))
    model = {n: given(F.col("party_name") if n == "party_name" else F.col("_item")[n]) for n in MODEL_FIELDS}
    each = each.withColumn("_m", _held(*[F.struct(c.alias("v"), F.when(c.isNotNull(), "high").otherwise("low").alias("level")).alias(n) for n, c in model.items()]))
    sane = _held(*[
        (_sane_party(F.col("_m.party_name")) if n == "party_name" else _sane(F.col("_m.regulator"), extract.sane_regulator) if n == "regulator" else F.col("_m")[n]).alias(n)
        for n in MODEL_FIELDS
    ])
    each = each.withColumn("_m", sane)
    pair = lambda x: (x["v"], x["level"])
    short = ("penalty_doc_no", "regulator", "party_name")
    merged, changed = merged_fields({n: pair(F.col("_m")[n]) for n in MODEL_FIELDS}, {n: pair(F.col("found")[n]) for n in short})
    fine = F.coalesce(first_group(F.coalesce(merged["penalty_content"][0], F.lit("")), extract.PATTERNS["fine_amount"][0]), F.col("found.fine_amount.v"))
    aux = {"fine_amount": fine, "publish_date": F.col("found.publish_date.v"), "legal_basis": F.col("found.legal_basis.v")}
    value = {n: merged[n] for n in merged if n in FIELDS} | {n: (c, F.when(c.isNotNull(), "medium").otherwise("low")) for n, c in aux.items()}
    usable = ~(_blank(merged["party_name"][0]) & _blank(merged["violation_behavior"][0]) & _blank(merged["penalty_content"][0]) & _blank(merged["regulator"][0]))
    each = each.withColumn("_use", F.col("_item").isNotNull() & usable)
    each = each.withColumn("_method", F.when(~F.col("_use"), "regex").when(changed, "hybrid").otherwise("llm"))
    each = each.withColumn("_new", _held(*[F.struct(F.nullif(strip(value[n][0]), F.lit("")).alias("v"), value[n][1].alias("level")).alias(n) for n in FIELDS]))
    label = strip(F.col("_item.institution_type"))
    settled = F.try_element_at(F.create_map(*[F.lit(x) for kv in SETTLED_TYPES.items() for x in kv]), F.when(F.col("_use"), label))
    each = each.withColumn("case_summary", F.when(F.col("_use"), F.col("_m.case_summary.v"))).withColumn("is_insurance_related", F.when(F.col("_use"), F.col("_item.is_insurance_related")))
    each = each.withColumn("found", F.when(F.col("_use"), F.col("_new")).otherwise(F.col("found"))).withColumn("_settled", settled)
    # A text none of whose items is usable is one case by patterns.
    each = each.select(key, "segment", "_use", "_method", "_settled", "found", "case_summary", "is_insurance_related", F.col("_i").alias("pos"), "party_name")
    w = Window.partitionBy(key)
    each = each.withColumn("_any", F.max("_use").over(w)).withColumn("_first", F.row_number().over(w.orderBy("pos", "party_name")))
    kept = each.where("_use or (not _any and _first = 1)").withColumn("pos", F.coalesce("pos", F.lit(0))).drop("party_name", "_any", "_first")
    return finished(kept, "segment", F.col("_method"), F.col("_settled")).drop("segment", "_use", "_method", "_settled")
