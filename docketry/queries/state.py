"""Changes of state and their counts, over the test tables: orders are cases, customers documents, suppliers logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import numbered
from docketry.operators import state as S
from docketry.plans.gold_import import GoldTables
from docketry.queries.base import query, rows, table, values
from docketry.storage import scratch


def _cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Clerk"), F.col("o_custkey").cast("string")).alias("party_name"), F.col("o_orderpriority").alias("regulator"), F.col("o_orderstatus").alias("case_summary"),
                    (F.col("o_orderkey") % 3 == 0).alias("related"), (F.col("o_orderkey") % 3 == 1).alias("candidate"))


CASES = "(select o_orderkey case_id, 'Clerk' || o_custkey party_name, o_orderpriority regulator, o_orderstatus case_summary, o_orderkey % 3 = 0 related, o_orderkey % 3 = 1 candidate from orders)"


@query(f"select case_id, case when case_id % 5 = 0 then 'P' || case_id else party_name end party_name, regulator, case_summary from {CASES}")
def patch_cases(spark, sf_dir):
    """Patches of two fields, one of which may not be changed; null leaves the regulator."""
    c = _cases(spark, sf_dir).select("case_id", "party_name", "regulator", "case_summary")
    p = c.where("case_id % 5 = 0").select("case_id", F.concat(F.lit("P"), F.col("case_id").cast("string")).alias("party_name"), F.lit(None).cast("string").alias("regulator"), F.lit("no").alias("case_summary"))
    return S.patched(c, p)


@query(f"select case_id, case when case_id % 4 = 1 then true when case_id % 4 = 2 then false else related end related, case when case_id % 4 in (1, 2) then false else candidate end candidate, case_id % 4 <> 2 indexed from {CASES}")
def confirm_or_exclude(spark, sf_dir):
    """Decisions on half of the cases; excluded ones leave the index."""
    c = _cases(spark, sf_dir)
    d = c.where("case_id % 4 in (1, 2)").select("case_id", (F.col("case_id") % 4 == 1).alias("confirm"))
    kept = S.without_excluded(c.select("case_id"), d).withColumn("indexed", F.lit(True))
    return S.decided(c, d).join(kept, "case_id", "left").select("case_id", "related", "candidate", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query("select (select count(*) from customer where c_nationkey % 5 not in (0, 1)) n_documents, (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey % 5 not in (0, 1)) n_cases")
def cascade_delete_documents(spark, sf_dir):
    """Documents of some regions go with their cases."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), "c_nationkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), "o_orderkey")
    docs, cases = S.cascade(d.where("c_nationkey % 5 in (0, 1)"), "file_id", d, c)
    return docs.agg(F.count("*").alias("n_documents")).crossJoin(cases.agg(F.count("*").alias("n_cases")))  # two single rows


@query("""select s_suppkey review_id, case when s_suppkey % 3 = 0 then 'helpful' when s_suppkey % 2 = 0 then 'old' end feedback, case when s_suppkey % 3 = 0 then s_name when s_suppkey % 2 = 0 then 'n' end feedback_note,
  (select count(*) from nation where n_nationkey % 4 in (0, 1)) + (select count(*) from supplier where s_suppkey % 3 <> 0 and s_suppkey % 2 <> 0) pending from supplier""")
def review_feedback(spark, sf_dir):
    """Feedback given for a third of the logs, and how many reviews are left."""
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    logs = s.select(F.col("s_suppkey").alias("review_id"), F.when(even, "old").alias("feedback"), F.when(even, "n").alias("feedback_note"))
    given = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("review_id"), F.lit("helpful").alias("feedback"), F.col("s_name").alias("feedback_note"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "reviewing", "done", "failed")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    after = S.with_feedback(logs, given)
    left = S.pending_reviews(table(spark, sf_dir, "nation").select(status.alias("review_status")), after)
    return after.crossJoin(F.broadcast(left))  # one row


PAIRS = [("f", 3.0, 1, 1), ("f", 5.0, 1, 2), ("f", 4.0, 2, 2), ("f", 3.5, 2, 1), ("g", 2.9, 1, 1), ("g", 3.0, 2, 1), ("g", 3.0, 1, 2), ("h", 9.0, 1, 1), ("h", 9.0, 2, 1)]
SIDES = [("f", 1), ("f", 2), ("f", 3), ("g", 1), ("g", 2), ("h", 1), ("h", 2)]


@query("select * from " + values("g, i, j", [("f", 1, 2), ("f", 2, 1), ("f", 3, None), ("f", None, 3), ("g", 2, 1), ("g", 1, 2), ("h", 2, 1), ("h", 1, None), ("h", None, 2)]))
def greedy_assignment(spark, sf_dir):
    """Pairs from the best down, each side once, and what is left of both sides: expected values by hand."""
    taken = S.assigned(rows(spark, "g string, score double, i int, j int", PAIRS), "g")
    return S.all_sides(taken, rows(spark, "g string, i int", SIDES), rows(spark, "g string, j int", SIDES), "g")


@query("""select p_partkey, round(0.82 + 0.14 * ((case when p_partkey % 2 = 0 then 1 else 0 end + case when p_partkey % 3 = 0 then 1 else 0 end + 1 + 0) / 4.0::double), 3) confidence,
  least(95, 58 + floor(37 * (p_partkey % 50) / 40.0::double))::int percent from part""")
def gold_confidence(spark, sf_dir):
    """Confidence of gold rows by filled fields; percent of a task."""
    i = F.col("p_partkey")
    c = S.gold_confidence(F.when(i % 2 == 0, F.col("p_name")), F.when(i % 3 == 0, F.col("p_brand")).otherwise(" "), F.col("p_size"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("confidence"), S.task_percent(i % 50, F.lit(40)).alias("percent"))


@query("select (select count(*) + 1 from orders) total, count(case when o_orderstatus <> 'P' then 1 end) submitted, count(case when o_orderstatus = 'P' then 1 end) failed, count(distinct o_custkey) unique_ids, false schema_ok from orders")
def batch_outcome(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), (F.col("o_orderstatus") != "P").alias("ok"))
    return S.outcome(o, o.count() + 1)


@query("""select qid, string_agg(channel || '=' || n, ',' order by channel) stats from (select o_custkey qid, o_orderpriority channel, count(*) n from orders group by all) group by qid""")
def channel_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("channel"))
    pairs = F.transform(F.array_sort(F.map_entries("stats")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return S.channel_counts(o).select("qid", F.array_join(pairs, ",").alias("stats"))


@query("""with b as (select p_brand k, round(avg(p_size), 6) v from part group by 1), a as (select p_brand k, round(avg(p_size), 6) v from part where p_partkey % 2 = 0 group by 1),
d as (select k, round(a.v - b.v, 6) delta from a join b using (k)), s as (select *, case when delta > 0 then 'improved' else 'regressed' end side from d where delta <> 0)
select * from (select *, row_number() over (partition by side order by abs(delta) desc, k) rk from s) where rk <= 5""")
def label_movers(spark, sf_dir):
    """Brands whose mean size changes most between all parts and half of them."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_size", "p_partkey")
    mean = lambda d: d.groupBy("k").agg(F.round(F.avg("p_size"), 6).alias("v"))
    return S.movers(mean(p), mean(p.where("p_partkey % 2 = 0")), "k", "v", 5)


@query("select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by coalesce(case when s_suppkey % 3 = 0 then s_acctbal end, -1.0::double) desc, s_suppkey) rk from supplier")
def reports_by_score(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal").cast("double")).alias("hit_score"))
    return S.by_hit_score(s, "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey", "rk")


GOLD_OLD = "(select printf('C%06d', doc_id) case_id, printf('F%06d', doc_id % 40) file_id, lang party_name, source regulator, text from documents where doc_id % 3 = 0)"


@query(f"""with old as {GOLD_OLD}, new as (select printf('C%06d', doc_id) case_id, printf('F%06d', doc_id % 60) file_id, case when doc_id % 4 = 0 then '未知当事人' else source end party_name,
  case when doc_id % 5 > 0 then lang end regulator, doc_id from documents where doc_id % 2 = 0),
c as (select case_id, file_id, party_name, 'gold' as method, case when case_id in (select case_id from old) then 'old' else 'competition_gold' end reason from new
  union all select case_id, file_id, party_name, 'old', 'old' from old where case_id not in (select case_id from new)),
r as (select file_id, max_by(regulator, doc_id) filter (where regulator is not null) regulator from new group by file_id),
o as (select file_id, min(regulator) regulator from old group by file_id)
select case_id, c.file_id, party_name, method, reason, coalesce(r.regulator, o.regulator) regulator from c left join r using (file_id) left join o using (file_id)""")
def gold_import(spark, sf_dir):
    """Cases and their documents after records were merged into tables that held a third of the cases before."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    none = lambda kind: F.lit(None).cast(kind)
    old = d.where(i % 3 == 0).select(numbered("C", i).alias("case_id"), numbered("F", i % 40).alias("file_id"), F.col("lang").alias("party_name"), F.col("source").alias("regulator"))
    known = old.groupBy("file_id").agg(F.min("regulator").alias("regulator")).select("file_id", F.lit("x").alias("file_name"), "regulator", none("string").alias("raw_text"), F.lit("done").alias("parse_status"))
    filled = old.select("*", *[none("string").alias(c) for c in ("institution_type", "penalty_doc_no", "case_summary")], *[F.lit("x").alias(c) for c in ("violation_behavior", "penalty_content")],
        F.lit(True).alias("related"), F.lit(True).alias("candidate"), F.array(F.lit("old")).alias("candidate_reasons"), *[F.array().cast("array<string>").alias(c) for c in ("risk_tags", "risk_type_ids")],
        F.lit(0.5).alias("confidence"), F.lit("old").alias("method"))
    g = GoldTables(spark, scratch(spark, "gold-tables"))
    g.replace(documents=known, cases=filled)
    records = d.where(i % 2 == 0).select(
        numbered("C", i).alias("case_id"), numbered("F", i % 60).alias("file_id"), i.alias("line"), F.when(i % 4 == 0, " ").otherwise(F.col("source")).alias("party_name"),
        *[none("string").alias(c) for c in ("institution_type", "penalty_doc_no", "violation_behavior", "case_summary")], F.col("text").alias("penalty_content"),
        F.when(i % 5 > 0, F.col("lang")).alias("regulator"), none("array<string>").alias("risk_tags"), F.lit(0.9).alias("confidence"),
    )
    g.merge(records, d.select(numbered("F", i).alias("file_id"), F.col("text").alias("raw_text")))
    shown = g.table("documents").select("file_id", "regulator")
    return g.table("cases").drop("regulator").join(shown, "file_id", "left").select("case_id", "file_id", "party_name", "method", F.col("candidate_reasons")[0].alias("reason"), "regulator")
