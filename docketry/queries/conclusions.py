"""Conclusions and judgements over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import conclude as K
from docketry.operators import retrieval as R
from docketry.queries.base import query, rounded, table
from docketry.queries.retrieval import RRF_SQL, _channels, _queries


def _found(spark, sf_dir):
    best = R.rrf(_channels(spark, sf_dir), 8)
    d = table(spark, sf_dir, "documents").select(F.format_string("C%06d", "doc_id").alias("case_id"), F.array("lang", "source").alias("tags"))
    return best.join(d, "case_id").select("qid", "rk", "case_id", "tags")


@query(f"""with f as (select r.qid, r.rk, r.case_id, d.lang, d.source from {RRF_SQL} r join documents d on printf('C%06d', d.doc_id) = r.case_id where rk <= 8),
t as (select qid, tag, min(p) p from (select qid, lang tag, rk * 2 p from f union all select qid, source, rk * 2 + 1 from f) group by all),
tt as (select qid, array_to_string(list_slice(list(tag order by p), 1, 3), ',') tags from t group by qid),
cc as (select qid, array_to_string(list_slice(list(case_id order by rk), 1, 5), ',') ids from f group by qid)
select item_id qid, coalesce(tags, '') tags, coalesce(ids, '') ids, case when ids is null then 0.0 else 0.3 end::double confidence from benchmark left join tt on item_id = tt.qid left join cc on item_id = cc.qid""")
def review_conclusions(spark, sf_dir):
    c = K.conclusions(_queries(spark, sf_dir), _found(spark, sf_dir))
    return c.select("qid", F.array_join("risk_types", ",").alias("tags"), F.array_join("case_ids", ",").alias("ids"), "confidence")


@query(f"select qid, case_id from {RRF_SQL} where rk <= 8 and substr(case_id, -1) <> '9'")
def traceability(spark, sf_dir):
    """Of an analysis that also names cases that were not found, what was found."""
    found = _found(spark, sf_dir)
    named = found.where("not endswith(case_id, '9')").select("qid", "case_id")
    invented = named.select("qid", F.concat("case_id", F.lit("X")).alias("case_id"))
    return K.traceable(named.unionByName(invented), found)


@query("""select conv_id, coalesce(nullif(array_to_string(list_transform(l, lambda x, i: i || '. ' || x), chr(10)), ''), '""" + K.MATERIAL_ADVICE + """') advice from (
  select conv_id, (select list(r order by t) from (select role r, min(turn) t from conversations c2 where c2.conv_id = c.conv_id and contains(c2.text, 'on') group by role)) l from (select distinct conv_id from conversations) c)""")
def numbered_advice(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.when(F.contains("text", F.lit("on")), F.struct("turn", "role"))))
    return c.groupBy("conv_id").agg(said.alias("s")).select("conv_id", K.material_advice(F.transform("s", lambda x: x["role"])).alias("advice"))


@query("select s_suppkey, '[案例 ' || s_suppkey || ']' || chr(10) || '  当事人：' || s_name || chr(10) || '  文号：' || case when s_suppkey % 2 = 0 then 'N/A' else n_name end context from supplier join nation on s_nationkey = n_nationkey")
def case_contexts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    number = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("n_name"))
    return s.select("s_suppkey", K.case_context(F.col("s_suppkey").cast("string"), {"当事人": F.col("s_name"), "文号": number}).alias("context"))


@query("""with e as (select o_custkey qid, o_orderkey case_id, row_number() over (partition by o_custkey order by o_orderkey) rk, case when o_orderkey % 3 = 0 then null when o_orderstatus = 'F' then 1 else 0 end s from orders)
select qid, round(avg(coalesce(s, 0)), 6) relevant_rate, max(coalesce(s, 0)) hit_any, round(coalesce(1.0::double / min(case when s = 1 then rk end), 0), 6) mrr from e group by qid""")
def retrieval_judge(spark, sf_dir):
    """Answers for two thirds of the expected cases, some repeated with the last one counting."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("case_id"), "o_orderstatus")
    expected = o.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("case_id")))
    answered = o.where("case_id % 3 <> 0").select("qid", "case_id", F.lit(2).alias("pos"), F.when(F.col("o_orderstatus") == "F", "2").otherwise("x").alias("raw"))
    earlier = answered.select("qid", "case_id", F.lit(1).alias("pos"), F.lit("1").alias("raw"))
    return K.judge_summary(K.judged(expected, answered.unionByName(earlier)))


@query("""select a.c_custkey, (case when a.c_mktsegment = b.c_mktsegment then 10 else 0 end + case when a.c_name = b.c_name then 5 else 0 end + least(2.0::double, length(a.c_name) / 200.0::double) + case when a.c_custkey % 2 = 0 then 1 else 0 end)::double score
  from customer a join customer b on b.c_custkey = a.c_custkey + 1""")
def record_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("no2"), F.col("c_name").alias("party2"))
    method = F.when(F.col("c_custkey") % 2 == 0, "llm").otherwise("regex")
    score = K.record_score(F.col("c_mktsegment"), F.col("no2"), F.col("c_name"), F.col("party2"), F.col("c_name"), method)
    return c.join(b, "c_custkey").select("c_custkey", score.alias("score"))


@query("""select a.o_orderpriority arm, round(b.v - a.v, 6) delta, b.n - a.n more from (select o_orderpriority, avg(o_totalprice) v, count(*) n from orders where o_orderkey % 2 = 0 group by 1) a
  join (select o_orderpriority, avg(o_totalprice) v, count(*) n from orders where o_orderkey % 2 = 1 group by 1) b using (o_orderpriority)""")
def arm_deltas(spark, sf_dir):
    """Metrics of two arms and their differences."""
    o = table(spark, sf_dir, "orders")
    arm = lambda k, s: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v" + s), F.count("*").alias("n" + s))
    both = arm(0, "0").join(arm(1, "1"), "o_orderpriority")
    return both.select(F.col("o_orderpriority").alias("arm"), rounded(F.col("v1") - F.col("v0")).alias("delta"), (F.col("n1") - F.col("n0")).alias("more"))
