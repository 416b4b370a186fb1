"""Table operations: filters, pages, counts, merges, ids, JSON metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import fine_value
from docketry.operators.fulltext import FullTextIndex, words
from docketry.storage import stored

#: Columns that a list may be sorted by.
SORTABLE = ("case_id", "regulator", "institution_type", "publish_date", "overall_confidence", "fine_amount")


@dataclass(frozen=True)
class CaseFilter:
    """What a case list asks for; None asks nothing."""

    queue: str | None = None
    risk: str | None = None
    regulator: str | None = None
    institution_type: str | None = None
    keyword: str | None = None
    date_from: str | None = None
    date_to: str | None = None


def queue_of(related: Column, candidate: Column) -> Column:
    return F.when(related, "confirmed").when(candidate, "pending").otherwise("excluded")


#: Columns whose text a keyword is looked for in.
KEYWORD_COLUMNS = ("violation_behavior", "penalty_content", "party_name", "case_summary", "risk_tags")


def apply_filter(cases: DataFrame, f: CaseFilter, index: FullTextIndex | None = None) -> DataFrame:
    """Rows of ``cases`` that fit; a risk is an id if it looks like one, else a tag; regulators match in part.

    A keyword asks for all its tokens, by the index of the cases if there is one; without any token it fits nothing.
    """
    if f.queue and f.queue != "all":
        cases = cases.where(queue_of(F.col("related"), F.col("candidate")) == f.queue)
    if f.risk:
        is_id = f.risk.upper().startswith("R0") and len(f.risk) <= 5
        cases = cases.where(F.array_contains("risk_type_ids", f.risk.upper()) if is_id else F.array_contains("risk_tags", f.risk))
    if f.regulator:
        cases = cases.where(F.ilike("regulator", F.lit(f"%{f.regulator}%")))
    if f.institution_type:
        cases = cases.where(F.col("institution_type") == f.institution_type)
    if f.keyword and index is not None:
        cases = cases.join(index.containing(f.keyword), "case_id", "left_semi")
    elif f.keyword:
        held = words(F.concat_ws(" ", *[c for c in KEYWORD_COLUMNS if c in cases.columns]))
        asked = F.array_distinct(words(F.lit(f.keyword)))
        cases = cases.where((F.size(asked) > 0) & (F.size(F.array_intersect(asked, held)) == F.size(asked)))
    if f.date_from:
        cases = cases.where(F.col("publish_date") >= F.lit(f.date_from).cast("date"))
    return cases.where(F.col("publish_date") <= F.lit(f.date_to).cast("date")) if f.date_to else cases


def page(df: DataFrame, sort: str, descending: bool, number: int, size: int, key: str) -> DataFrame:
    """One page; unknown sort columns fall back to the key; sizes are 1 to 100, nulls last, ties by key.

    Fines are texts and sort by their value.
    """
    column = F.col(sort if sort in SORTABLE and sort in df.columns else key)
    column = fine_value(column) if sort == "fine_amount" and sort in df.columns else column
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    size = max(1, min(100, size))
    return df.orderBy(order, F.col(key)).offset((max(1, number) - 1) * size).limit(size)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """As upsert, but nulls of ``new`` keep the old value."""
    o, n = old.alias("o"), new.alias("n")
    merged = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return merged.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def next_number(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row ``top``: the largest number behind the prefix, 0 if there is none."""
    n = F.when(F.col(column).rlike(f"^{prefix}[0-9]+$"), F.substring(column, len(prefix) + 1, 18).cast("long"))
    return ids.agg(F.coalesce(F.max(n), F.lit(0).cast("long")).alias("top"))


def allocate(new: DataFrame, existing: DataFrame, column: str, prefix: str, order: str) -> DataFrame:
    """Number the rows of ``new`` after the ids that exist, in ``order``, without a single-task sort.

    Rows are dealt by ranges of the order column, of any type that sorts, and stored with the number of their range, so
    that it stays what it is; each range's offset comes from a count of one row per range.
    """
    top = next_number(existing, column, prefix)
    ranged = stored(new.select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("row"), F.col(order).alias("at")).repartitionByRange("at").withColumn("part", F.spark_partition_id()), "allocated")
    counts = ranged.groupBy("part").count()
    offsets = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    numbered = ranged.join(F.broadcast(offsets.drop("count")), "part").crossJoin(F.broadcast(top))  # one row per range; one row
    return numbered.select("row.*", F.format_string(prefix + "%06d", F.col("top") + F.col("base") + inside).alias(column))


def merge_meta(old: Column, patch: Column) -> Column:
    """Shallow merge of string maps; the patch wins."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def drop_meta(meta: Column, *keys: str) -> Column:
    return F.map_filter(meta, lambda k, v: ~k.isin(*keys))


# The stages of ingestion in order.
STAGES = ("upload", "parse", "extract", "classify", "index")


def progress(status: Column, stage: Column) -> Column:
    """Share of stages done, with 0.45 for the one at work, 0 to 1."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.coalesce(stage, F.lit(STAGES[0])))
    done = F.when(status == "done", float(len(STAGES))).otherwise(F.greatest(at.cast("double") - 1, F.lit(0.0)))
    active = F.when(status.isin("parsing"), 0.45).otherwise(0.0)
    return F.round((done + active) / len(STAGES), 6)
