"""Metrics over the test tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docketry.operators import assignment
from docketry.operators.assignment import best_pairs
from docketry.operators.metrics import char_overlap, jaccard, prf
from docketry.queries.base import query, rounded, rows, table, values

LABELS_SQL = "(select l.doc_id, quality = 1 gold, contains(text, 'the') pred, source tag from labels l join documents d on l.doc_id = d.doc_id)"


def _labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("the")).alias("pred"), F.col("source").alias("tag"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")).join(d, "doc_id")


def _prf_sql(tp: str, fp: str, fn: str) -> str:
    p, r = f"case when {tp} + {fp} > 0 then {tp} / ({tp} + {fp})::double else 0 end", f"case when {tp} + {fn} > 0 then {tp} / ({tp} + {fn})::double else 0 end"
    return f"round({p}, 6) p, round({r}, 6) r, round(case when ({p}) + ({r}) > 0 then 2 * ({p}) * ({r}) / (({p}) + ({r})) else 0 end, 6) f1"


@query(f"select tag, tp, fp, fn, {_prf_sql('tp', 'fp', 'fn')} from (select tag, count(*) filter (where gold and pred) tp, count(*) filter (where not gold and pred) fp, count(*) filter (where gold and not pred) fn from {LABELS_SQL} group by tag)")
def label_metrics(spark, sf_dir):
    """Counts and scores of a rule's prediction per tag."""
    g, p = F.col("gold"), F.col("pred")
    s = _labels(spark, sf_dir).groupBy("tag").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("tag", "tp", "fp", "fn", *[rounded(c).alias(n) for c, n in zip(scores, ("p", "r", "f1"))])


@query(f"select round(avg(f1), 6) macro_f1, sum(support)::bigint support from (select {_prf_sql('tp', 'fp', 'fn')}, tp + fn support from (select tag, count(*) filter (where gold and pred) tp, count(*) filter (where not gold and pred) fp, count(*) filter (where gold and not pred) fn from {LABELS_SQL} group by tag)) where support > 0")
def macro_f1(spark, sf_dir):
    m = label_metrics(spark, sf_dir).withColumn("support", F.col("tp") + F.col("fn")).where("support > 0")
    return m.agg(rounded(F.avg("f1")).alias("macro_f1"), F.sum("support").alias("support"))


PAIRS = "(select a.p_partkey id, a.p_name gold, b.p_name pred from part a join part b on b.p_partkey = a.p_partkey + 1)"


@query(f"""with g as (select id, ch, count(*) g from (select id, unnest(string_split(replace(gold, ' ', ''), '')) ch from {PAIRS}) group by all),
p as (select id, ch, count(*) p from (select id, unnest(string_split(replace(pred, ' ', ''), '')) ch from {PAIRS}) group by all),
s as (select id, sum(least(coalesce(g, 0), coalesce(p, 0))) tp, sum(coalesce(g, 0)) g, sum(coalesce(p, 0)) p from g full join p using (id, ch) group by id)
select id, round(tp / p::double, 6) "precision", round(tp / g::double, 6) recall, round(case when tp > 0 then 2 * (tp / p::double) * (tp / g::double) / (tp / p::double + tp / g::double) else 0 end, 6) f1 from s""")
def char_overlap_f1(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pairs = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("gold")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("pred")), "id")
    return char_overlap(pairs, "id", "gold", "pred").select("id", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("""select a.p_partkey id, round(case when len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) = 0 then 1 else
  len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' '))))::double end, 6) jaccard
  from part a join part b on b.p_partkey = a.p_partkey + 1""")
def tag_jaccard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.split("p_name", " ").alias("b")), "id")
    return a.select("id", rounded(jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query("""select coalesce(a.k, b.k) k, coalesce(a.v, 0) base, coalesce(b.v, 0) new, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) delta from
  (select o_orderpriority k, round(avg(o_totalprice), 6) v from orders where o_orderstatus = 'F' group by 1) a full join
  (select o_orderpriority k, round(avg(o_totalprice), 6) v from orders where o_orderstatus = 'O' group by 1) b using (k)""")
def report_diff(spark, sf_dir):
    """Two reports joined on their key, with the change."""
    part = lambda s, n: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(rounded(F.avg("o_totalprice")).alias(n))
    both = part("F", "base").join(part("O", "new"), "k", "full").na.fill(0.0)
    return both.select("k", "base", "new", rounded(F.col("new") - F.col("base")).alias("delta"))


SUBMISSIONS = [("q1", "销售误导", ["C1"]), ("q1", "虚假宣传", ["C2"]), (None, "x", ["C3"]), ("q2", "", ["C4"]), ("q3", "x", []), ("q4", "x", ["C5", "C6"])]
CHECKED = [("q1", "duplicate", 2), (None, "question_id missing", 1), ("q2", "risk_type empty", 1), ("q3", "no cases", 1), ("q4", "ok", 1)]


@query(f"select * from {values('question_id, state, n', CHECKED)}")
def submission_validate(spark, sf_dir):
    from pyspark.sql import Window

    s = rows(spark, "question_id string, risk_type string, case_ids array<string>", SUBMISSIONS)
    again = (F.count("*").over(Window.partitionBy("question_id")) > 1) & F.col("question_id").isNotNull()
    state = (
        F.when(F.coalesce("question_id", F.lit("")) == "", "question_id missing").when(F.col("again"), "duplicate").when(F.col("risk_type") == "", "risk_type empty")
        .when(F.size("case_ids") < 1, "no cases").otherwise("ok")
    )
    return s.withColumn("again", again).groupBy("question_id", state.alias("state")).agg(F.count("*").cast("int").alias("n"))


def assign(gold, pred):
    """Within each file, the pairing of gold and predicted parties with the largest total similarity.

    A group is the cases of one file, a handful of rows.
    """

    def similarity(a: str, b: str) -> float:
        a, b = a.replace(" ", ""), b.replace(" ", "")
        return 3.0 if a == b else 1.5 if a in b or b in a else 0.0

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = np.array([[similarity(a, b) for b in right["name"]] for a in left["name"]]).reshape(len(left), len(right))
        return pd.DataFrame([(left["file"].iloc[i], left["name"].iloc[i], right["name"].iloc[j], s[i, j]) for i, j in best_pairs(s)], columns=["file", "gold", "pred", "score"])

    return gold.groupBy("file").cogroup(pred.groupBy("file")).applyInPandas(run, "file string, gold string, pred string, score double")


@query(f"select * from {values('file, gold, pred, score', [('f1', '甲公司', '甲公司', 3.0), ('f1', '乙公司分部', '乙公司', 1.5), ('f2', 'A', 'A', 3.0)])}")
def assignment_match(spark, sf_dir):
    g = rows(spark, "file string, name string", [("f1", "甲公司"), ("f1", "乙公司分部"), ("f1", "丙"), ("f2", "A"), ("f3", "x")])
    p = rows(spark, "file string, name string", [("f1", "乙公司"), ("f1", "甲公司"), ("f2", "AB"), ("f2", "A")])
    return assign(g, p)


@query("""select role, count(*) n, round(avg(score), 6) mean_score, round(avg(case when score = 2 then 1.0 else 0.0 end::double), 6) top_share, count(*) filter (where score >= 1) n_relevant from (
  select role, case when length(text) > 300 then 2 when length(text) > 100 then 1 else 0 end score from conversations) group by role""")
def judge_metrics(spark, sf_dir):
    """Graded judgements, clamped to 0 to 2, rolled up."""
    score = F.when(F.length("text") > 300, 2).when(F.length("text") > 100, 1).otherwise(0)
    c = table(spark, sf_dir, "conversations").select("role", score.alias("score"))
    return c.groupBy("role").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean_score"), rounded(F.avg((F.col("score") == 2).cast("double"))).alias("top_share"), F.count_if(F.col("score") >= 1).alias("n_relevant"))


@query("""select field, tp, fp, fn from (select 'name' field, count(*) filter (where g = p) tp, count(*) filter (where p is not null and g is distinct from p) fp, count(*) filter (where g is not null and g is distinct from p) fn from (
  select a.c_mktsegment g, case when a.c_custkey % 3 = 0 then null else b.c_mktsegment end p from customer a join customer b on b.c_custkey = a.c_custkey + 1))""")
def extraction_prf(spark, sf_dir):
    """Field scores: values that differ count as false positive and as false negative."""
    c = table(spark, sf_dir, "customer")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("other"))
    pair = c.join(b, "c_custkey").select(F.col("c_mktsegment").alias("g"), F.when(F.col("c_custkey") % 3 != 0, F.col("other")).alias("p"))
    same = F.col("g").eqNullSafe(F.col("p"))
    return pair.agg(F.count_if(F.col("g") == F.col("p")).alias("tp"), F.count_if(F.col("p").isNotNull() & ~same).alias("fp"), F.count_if(F.col("g").isNotNull() & ~same).alias("fn")).select(F.lit("name").alias("field"), "tp", "fp", "fn")


@query(f"""select tag, count(*) n_gold, count(*) filter (where pred) n_hit, round(count(*) filter (where pred) / count(*)::double, 6) recall from {LABELS_SQL} where gold group by tag""")
def keyword_prf(spark, sf_dir):
    g = _labels(spark, sf_dir).where("gold")
    return g.groupBy("tag").agg(F.count("*").alias("n_gold"), F.count_if("pred").alias("n_hit"), rounded(F.count_if("pred") / F.count("*")).alias("recall"))


@query("""with c as (select doc_id i, '第' || doc_id || '公司' firm, text, source, lang, '罚款' || doc_id || '万元' fine from documents),
b as (select i, i % 5 <> 0 has, case when i % 7 = 0 then '当事人：' || firm else firm end gp, case when i % 5 <> 0 then case when i % 11 = 0 then firm[:-2] else firm end else '' end ep, firm,
  case when i % 5 <> 0 and i % 3 <> 0 then 'N' || i else '' end ed, source gr, case when i % 5 = 0 then '' when i % 4 = 0 then 'x' else source end er, lang gl, case when i % 5 <> 0 then lang else '' end el,
  case when i % 6 = 0 then '见原文' else fine end gc, case when i % 5 <> 0 then fine else '' end ec, length(regexp_replace(text, '\\s', '', 'g')) gv,
  case when i % 5 = 0 then 0 when i % 3 = 0 then length(regexp_replace(substr(text, 1, length(text) // 2), '\\s', '', 'g')) else length(regexp_replace(text, '\\s', '', 'g')) end ev,
  length(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ', '')) gn, case when i % 5 = 0 then 0 when i % 3 = 0 then length(translate(regexp_replace(substr(text, 1, length(text) // 2), '^\\s+|\\s+$', '', 'g'), ' ', ''))
    else length(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ', '')) end en from c),
x as (select 'fields' part, unnest([{f: 'party_name', g: gp, e: ep, z: false}, {f: 'penalty_doc_no', g: 'N' || i, e: ed, z: false}, {f: 'regulator', g: gr, e: er, z: false}, {f: 'institution_type', g: gl, e: el, z: false}]) u from b
  union all select 'adjusted', unnest([{f: 'party_name', g: firm, e: ep, z: true}, {f: 'penalty_doc_no', g: 'N' || i, e: ed, z: true}]) from b),
k as (select part, u.f field, count(*) filter (h) tp, count(*) filter (u.e <> '' and not h) fp, count(*) filter (u.g <> '' and not h) fn, count(*) n from
  (select *, u.g <> '' and u.e <> '' and (u.g = u.e or (u.z and (starts_with(u.g, u.e) or starts_with(u.e, u.g)))) h from x) where u.g <> '' or u.e <> '' group by all),
m as (select part, field, case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end p, case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end r, n, 0 excluded from k),
w as (select part, field, round(p, 4)::double p, round(r, 4)::double r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4)::double f, n, excluded from m),
o as (select 'fields' part, 'penalty_content' field, avg(case when ec = '' then 0.0 when gc = ec then 1.0 else 0.0 end::double) f, count(*) n, 0 excluded from b
  union all select 'adjusted', 'penalty_content', avg(case when ec = gc then 1.0 else 0.0 end::double), count(*), (select count(*) from b where gc = '见原文') from b where gc <> '见原文'),
v as (select avg(case when ev > 0 then 1.0 else 0.0 end::double) p, avg(case when gv > 0 then ev / gv::double else 0.0 end) r, avg(case when ev > 0 then 2.0 * ev / (ev + gv) else 0.0 end::double) f, count(*) n,
  avg(case when en > 0 and en < 0.7::double * gn then 1.0 else 0.0 end::double) t from b where gn > 0 or en > 0),
s as (select part, field, p "precision", r recall, f f1, n, excluded from w union all select part, field, round(f, 4)::double, round(f, 4)::double, round(f, 4)::double, n, excluded from o
  union all select 'fields', 'violation_behavior', round(p, 4)::double, round(r, 4)::double, round(f, 4)::double, n, 0 from v)
select * from s union all select 'truncated', 'violation_behavior', round(t, 4)::double, null, null, n, 0 from v
union all select 'truncated', 'penalty_content', 0.0, null, null, count(*), 0 from b
union all select 'insurance', 'is_insurance_related', round(avg(case when (i % 2 = 0) = (i % 4 = 0) then 1.0 else 0.0 end::double), 4)::double, null, null, count(*), 0 from b where has
union all select 'macro', 'all', null, null, round(sum(f1) / 6, 4)::double, 6, 0 from s where part = 'fields'""")
def case_metrics(spark, sf_dir):
    """Cases of all documents against altered, cut and missing ones, three to a file: optimal pairs, plain and adjusted metrics."""
    i = F.col("doc_id")
    text = F.concat(F.lit("第"), i.cast("string"), F.lit("公司"))
    fine = F.concat(F.lit("罚款"), i.cast("string"), F.lit("万元"))
    number = F.concat(F.lit("N"), i.cast("string"))
    d = table(spark, sf_dir, "documents")
    gold = d.select(
        F.floor(i / 3).alias("file"), i.alias("gold_id"), F.when(i % 7 == 0, F.concat(F.lit("当事人："), text)).otherwise(text).alias("party_name"), number.alias("penalty_doc_no"),
        F.col("source").alias("regulator"), F.col("lang").alias("institution_type"), F.col("text").alias("violation_behavior"),
        F.when(i % 6 == 0, "见原文").otherwise(fine).alias("penalty_content"), (i % 2 == 0).alias("is_insurance_related"),
    )
    half = F.when(i % 3 == 0, F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    pred = d.where(i % 5 != 0).select(
        F.floor(i / 3).alias("file"), i.alias("pred_id"), F.when(i % 11 == 0, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("party_name"),
        F.when(i % 3 != 0, number).alias("penalty_doc_no"), F.when(i % 4 == 0, "x").otherwise(F.col("source")).alias("regulator"), F.col("lang").alias("institution_type"),
        half.alias("violation_behavior"), fine.alias("penalty_content"), (i % 4 == 0).alias("is_insurance_related"),
    )
    pairs = assignment.matched(gold, pred, "file")
    return assignment.case_metrics(assignment.side_by_side(pairs, gold, pred))
