"""Changes of state and the counts that follow from them: patches, confirmation, feedback, pairing of old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that a patch may change, and the least score of a pair.
PATCHABLE = ("party_name", "penalty_doc_no", "violation_behavior", "penalty_content", "regulator", "legal_basis", "risk_tags", "risk_type_ids", "is_insurance_related")
LEAST_PAIR_SCORE = 3.0
FEEDBACK_LEFT = ("pending", "reviewing")


def patched(cases: DataFrame, patches: DataFrame, key: str = "case_id") -> DataFrame:
    """Patches (key, field columns; null leaves a field) applied to the fields that may be changed, others ignored."""
    fields = [c for c in patches.columns if c in PATCHABLE and c in cases.columns]
    new = patches.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return cases.join(new, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in cases.columns])


def decided(cases: DataFrame, decisions: DataFrame, key: str = "case_id") -> DataFrame:
    """Decisions (key, confirm): a confirmed candidate is related, an excluded case neither related nor a candidate."""
    d = cases.join(decisions.select(key, F.col("confirm").alias("__confirm")), key, "left")
    flags = {"related": F.coalesce("__confirm", "related"), "candidate": F.when(F.col("__confirm").isNotNull(), False).otherwise(F.col("candidate"))}
    return d.select(*[flags[c].alias(c) if c in flags else F.col(c) for c in cases.columns])


def without_excluded(index: DataFrame, decisions: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of an index whose case was not excluded."""
    return index.join(decisions.where("not confirm").select(key), key, "left_anti")


def cascade(keys: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of ``keys``: a delete and what hangs on it."""
    return [t.join(keys.select(key), key, "left_anti") for t in tables]


def with_feedback(logs: DataFrame, feedback: DataFrame, key: str = "review_id") -> DataFrame:
    """Logs with the feedback and note given for them."""
    new = feedback.select(key, F.col("feedback").alias("__feedback"), F.col("feedback_note").alias("__note"))
    d = logs.join(new, key, "left")
    given = F.col("__feedback").isNotNull()
    flags = {"feedback": F.coalesce("__feedback", "feedback"), "feedback_note": F.when(given, F.col("__note")).otherwise(F.col("feedback_note"))}
    return d.select(*[flags[c].alias(c) if c in flags else F.col(c) for c in logs.columns])


def pending_reviews(materials: DataFrame, logs: DataFrame) -> DataFrame:
    """One row ``pending``: materials not reviewed yet and logs without feedback."""
    left = materials.agg(F.count_if(F.col("review_status").isin(*FEEDBACK_LEFT)).alias("a"))
    return left.crossJoin(logs.agg(F.count_if(F.col("feedback").isNull()).alias("b"))).select((F.col("a") + F.col("b")).alias("pending"))  # two single rows


def assigned(pairs: DataFrame, group: str) -> DataFrame:
    """(group, i, j, score): pairs taken one by one from the best, each side once; scores below the least are none.

    One fold over the sorted pairs of a group; of equal scores the larger i, then j, comes first.
    """
    listed = pairs.where(F.col("score") >= LEAST_PAIR_SCORE).groupBy(group)
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("score", "i", "j")), asc=False).alias("pairs"))
    taken = F.expr("""aggregate(pairs, cast(array() as array<struct<score: double, i: int, j: int>>), (out, p) ->
        if(exists(out, x -> x.i = p.i or x.j = p.j), out, concat(out, array(struct(p.score as score, p.i as i, p.j as j)))))""")
    return listed.select(group, F.inline(taken))


def all_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Matched pairs, then rows of either side that no pair holds: (group, i, j)."""
    both = pairs.select(group, "i", "j")
    lone_left = left.select(group, "i").join(both, [group, "i"], "left_anti").select(group, "i", F.lit(None).cast("int").alias("j"))
    lone_right = right.select(group, "j").join(both, [group, "j"], "left_anti").select(group, F.lit(None).cast("int").alias("i"), "j")
    return both.unionByName(lone_left).unionByName(lone_right)


def gold_confidence(*fields: Column) -> Column:
    """0.82 to 0.96 by the share of fields that are filled."""
    filled = sum((F.trim(F.coalesce(f.cast("string"), F.lit(""))) != "").cast("int") for f in fields)
    return F.round(0.82 + 0.14 * (filled / len(fields)), 3)


def task_percent(done: Column, total: Column) -> Column:
    """Progress of a task's last stretch, 58 to 95."""
    return F.least(F.lit(95), F.lit(58) + F.floor(37 * done / F.greatest(total, F.lit(1)))).cast("int")


def outcome(rows: DataFrame, total: int | Column) -> DataFrame:
    """One row over (question_id, ok): total, submitted, failed, unique ids, and whether all is as it should be."""
    n = F.lit(total) if isinstance(total, int) else total
    a = rows.agg(F.count_if("ok").alias("submitted"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("question_id").alias("unique_ids"))
    return a.select(n.cast("long").alias("total"), "submitted", "failed", "unique_ids", ((F.col("submitted") == n) & (F.col("failed") == 0)).alias("schema_ok"))


def channel_counts(channels: DataFrame) -> DataFrame:
    """(qid, stats): how many candidates each channel of a query gave, as a map."""
    n = channels.groupBy("qid", "channel").count()
    return n.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "count")))).alias("stats"))


def movers(before: DataFrame, after: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, delta, side, rk): the n keys that gained most and the n that lost most."""
    d = before.select(key, F.col(value).alias("__b")).join(after.select(key, F.col(value).alias("__a")), key)
    d = d.select(key, F.round(F.col("__a") - F.col("__b"), 6).alias("delta")).where("delta <> 0")
    side = F.when(F.col("delta") > 0, "improved").otherwise("regressed")
    w = Window.partitionBy("side").orderBy(F.abs("delta").desc(), key)
    return d.withColumn("side", side).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)


def by_hit_score(reports: DataFrame, group: str, key: str) -> DataFrame:
    """Rank of reports by their score; those without one come last."""
    w = Window.partitionBy(group).orderBy(F.coalesce(F.col("hit_score"), F.lit(-1.0)).desc(), key)
    return reports.withColumn("rk", F.row_number().over(w))
