"""Retrieval over the test tables: items of ``benchmark`` are the queries, documents and embeddings the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import numbered
from docketry.operators import retrieval as R
from docketry.operators.checks import small
from docketry.operators.fulltext import FullTextIndex
from docketry.operators.permits import Permit
from docketry.plans.backend import Backend
from docketry.queries.base import CASES_SQL, cases, query, rounded, rows, table, values

TOKEN_SQL = "'[一-鿿]{2,8}|[A-Za-z0-9]{2,}'"
#: Business terms are LIKE patterns; terms of the test corpus stand for the trade's own.
SYNONYMS = [("the", "article", "R001"), ("on%ion", "motion", "R002"), ("th_", "deixis", "R003"), ("est", "superlative", "R004"), ("ñ", "tilde", "R005"), ("heit", "suffix", "R006")]
RULES = [(1, r"\bthe\b.*\bof\b", "R002"), (2, r"^[A-Z]", "R001"), (3, r"[éè]", "R007"), (4, r"\d{3}", "R008")]


def at_k(sql: str, k: int) -> str:
    return sql.replace("{k}", str(k))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(numbered("C", F.col("doc_id")).alias("case_id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> FullTextIndex:
    """The index of the corpus; it stays for further queries on the same files."""
    return FullTextIndex.of(_corpus(spark, sf_dir), "fulltext-documents")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    corpus = e.select(numbered("C", F.col("vec_id")).alias("case_id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), corpus


DENSE_SQL = """(select * from (
  select q.vec_id qid, printf('C%06d', c.vec_id) case_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) score,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) desc, printf('C%06d', c.vec_id)) rk
  from embeddings q cross join embeddings c where q.vec_id % 50 = 0) where rk <= {k})"""


@query("select qid, case_id, score, rk from " + at_k(DENSE_SQL, 200))
def dense_topk(spark, sf_dir):
    """Exact cosine neighbours of every fiftieth vector, in blocks."""
    return R.dense(*_vectors(spark, sf_dir), R.DEPTH["dense"]).select("qid", "case_id", "score", "rk")


BENCHMARK, DOCUMENTS = "(select item_id qid, text from benchmark)", "(select printf('C%06d', doc_id) case_id, text from documents)"


def lexical_sql(queries: str = BENCHMARK, docs: str = DOCUMENTS, permit: str = "true") -> str:
    """The lexical channel in SQL; ``permit`` is a condition over qid and case_id."""
    return f"""(
with q as (select distinct qid, unnest(regexp_extract_all(lower(text), {TOKEN_SQL})) token from {queries}),
n as (select qid, count(*) n_tokens from q group by qid),
d as (select case_id, unnest(regexp_extract_all(lower(text), {TOKEN_SQL})) token from {docs}),
tf as (select case_id, token, count(*) tf from d where token in (select token from q) group by all),
h as (select qid, case_id, count(*) n_hits, sum(tf) tf from q join tf using (token) where {permit} group by all),
k as (select h.*, n_tokens, n_hits = n_tokens is_and, max(n_hits = n_tokens) over (partition by qid) any_and from h join n using (qid))
select * from (select qid, case_id, n_hits::double score, is_and, row_number() over (partition by qid order by n_hits desc, tf desc, case_id) rk
  from k where is_and or not any_and) where rk <= {{k}})"""


LEXICAL_SQL = lexical_sql()


@query("select qid, case_id, score, rk from " + at_k(LEXICAL_SQL, 80))
def lexical_and_or(spark, sf_dir):
    """All tokens of a query, else any; ranked by tokens and occurrences."""
    return R.lexical(_queries(spark, sf_dir), _index(spark, sf_dir), R.DEPTH["bm25"]).select("qid", "case_id", "score", "rk")


def _sparse_inputs(spark, sf_dir):
    postings = _corpus(spark, sf_dir).select("case_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("token"))
    postings = postings.groupBy("case_id", "token").agg(F.count("*").cast("double").alias("w"))
    q = _queries(spark, sf_dir).select("qid", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("token"))
    return q.groupBy("qid", "token").agg(F.count("*").cast("double").alias("w")), postings


SPARSE_SQL = """(
with p as (select printf('C%06d', doc_id) case_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) token from documents),
pw as (select case_id, token, count(*)::double w from p group by all),
q as (select item_id qid, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) token from benchmark),
qw as (select qid, token, count(*)::double w from q group by all),
s as (select qid, case_id, round(sum(qw.w * pw.w), 6) score from qw join pw using (token) group by all)
select * from (select *, row_number() over (partition by qid order by score desc, case_id) rk from s) where rk <= {k})"""


@query("select qid, case_id, score, rk from " + at_k(SPARSE_SQL, 100))
def sparse_inner_product(spark, sf_dir):
    return R.sparse(*_sparse_inputs(spark, sf_dir), R.DEPTH["sparse"]).select("qid", "case_id", "score", "rk")


@query("select s.qid, s.case_id, s.score from " + at_k(SPARSE_SQL, 100) + " s join " + CASES_SQL + " c using (case_id) where c.related")
def sparse_postfilter(spark, sf_dir):
    """The filter stands above the ranking: a query may get fewer than k."""
    best = R.sparse(*_sparse_inputs(spark, sf_dir), R.DEPTH["sparse"])
    return best.join(cases(spark, sf_dir).where("related").select("case_id"), "case_id").select("qid", "case_id", "score")


@query("""select * from (select q.p_partkey qid, printf('C%06d', c.p_partkey) case_id, count(*)::double score,
  row_number() over (partition by q.p_partkey order by count(*) desc, max(c.p_retailprice) desc, printf('C%06d', c.p_partkey)) rk
  from (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) tag from part where p_partkey % 50 = 0) q
  join (select p_partkey, p_retailprice, unnest(list_distinct(string_split(p_name, ' '))) tag from part) c using (tag)
  group by q.p_partkey, c.p_partkey) where rk <= 10""")
def tag_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), "tags")
    c = p.select(numbered("C", F.col("p_partkey")).alias("case_id"), "tags", F.col("p_retailprice").alias("confidence"))
    return R.tag_overlap(q, c, 10).select("qid", "case_id", "score", "rk")


SYN_SQL = values("business_term, standard_term, risk_id", SYNONYMS)


def _synonyms(spark):
    return rows(spark, "business_term string, standard_term string, risk_id string", SYNONYMS)


@query(f"""select item_id qid, text, coalesce((select array_to_string(list_slice(list_sort(list_distinct(list(standard_term))), 1, 10), ' ')
  from {SYN_SQL} s where b.text like concat('%', business_term, '%')), '') expansion from benchmark b""")
def synonym_expand(spark, sf_dir):
    return R.expand_synonyms(_queries(spark, sf_dir), _synonyms(spark))


@query(f"""with f as (select doc_id qid, 0 tier, rule_id pos, risk_id from documents join {values('rule_id, pattern, risk_id', RULES)} r on regexp_matches(text, pattern)
  union all select distinct doc_id, 1, 0, risk_id from documents join {SYN_SQL} s on text like concat('%', business_term, '%')),
g as (select qid, risk_id, min((tier, pos, risk_id)) k from f group by all),
o as (select qid, array_to_string(list_slice(list(risk_id order by k), 1, 3), ',') risks from g group by qid)
select doc_id qid, coalesce(risks, '') risks from documents left join o on doc_id = qid""")
def risk_predict(spark, sf_dir):
    """Risk ids of every document by rules, then by dictionary."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text")
    return R.predict_risks(docs, [*RULES, (9, "(unclosed", "R009")], SYNONYMS).select("qid", F.array_join("risk_ids", ",").alias("risks"))


#: Entries for all ends of the cascade: terms that documents hold together, apart, and not at all.
ENTRIES = [
    ("den ", "und der", "R001", 0.9), ("que ", "que los dans zzqx", "R002", 0.8), ("the ", "zzqx qqzx", "R003", 0.7), ("ñ", "xxqz", "R003", 0.6),
    ("on%ion", "zzqx", "R004", 0.5), ("dans ", "pour les", None, 0.4), ("mente", "xxqz qqzx", "R005", 0.95),
]
RULE_CASES_SQL = f"""(select c.*, ['R00' || (doc_id % 7 + 1), 'R00' || (doc_id % 3 + 1)] ids, (doc_id % 13)::double confidence from {CASES_SQL} c)"""


@query(f"""with e as {values('business_term, standard_term, risk_id, weight', ENTRIES)}, c as materialized {RULE_CASES_SQL},
m as (select item_id qid, e.*, row_number() over (partition by item_id order by weight desc, business_term) o from benchmark join e on text like concat('%', business_term, '%') qualify o <= 20),
t as (select qid, standard_term, min(o) o from m group by all), x as (select qid, string_agg(standard_term, ' ' order by o) text from t group by qid),
a as (select qid, '命中规则词典：' || string_agg(business_term, '、' order by o) reason from m group by qid),
f as materialized {at_k(lexical_sql('x', '(select case_id, violation_behavior text from c)', 'case_id in (select case_id from c where related)'), 30)},
i as (select qid, case_id, count(*)::double score, max(confidence) confidence from (select distinct qid, risk_id from m where risk_id is not null and qid not in (select qid from f)) w
  join (select case_id, confidence, unnest(list_distinct(ids)) risk_id from c where related) using (risk_id) group by all)
select qid, case_id, score, rk, case when is_and then 'and' else 'or' end tier, reason from f join a using (qid) union all
select qid, case_id, score, rk, 'ids', reason from (select *, row_number() over (partition by qid order by score desc, confidence desc, case_id) rk from i) join a using (qid) where rk <= 30""")
def rule_channel(spark, sf_dir):
    """Dictionary terms of a query lead to cases with all of them, else with any, else with their risk ids."""
    c = rule_cases(spark, sf_dir)
    entries = rows(spark, "business_term string, standard_term string, risk_id string, weight double", ENTRIES)
    found = R.rule_channel(_queries(spark, sf_dir), _index(spark, sf_dir), entries, c, R.DEPTH["rule"], Permit.of(_queries(spark, sf_dir), c))
    return found.select("qid", "case_id", "score", "rk", "tier", "reason")


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ids = F.array(F.concat(F.lit("R00"), (i % 7 + 1).cast("string")), F.concat(F.lit("R00"), (i % 3 + 1).cast("string")))
    return cases(spark, sf_dir).withColumn("risk_type_ids", ids).withColumn("confidence", (i % 13).cast("double"))


PERMIT_SQL = f"""exists (select 1 from (select *, case when item_id % 3 = 0 then 'rc1' end g, case when item_id % 4 = 1 then 'en' else '' end t, case when item_id % 5 = 2 then 'R002' end r,
    case when item_id % 6 = 3 then date '2024-02-01' end df from benchmark) b, {RULE_CASES_SQL} c where b.item_id = qid and c.case_id = tf.case_id and related and (g is null or regulator = g)
    and (t = '' or institution_type = t) and (r is null or list_contains(ids, r)) and (df is null or date '2024-01-01' + (doc_id % 100)::int >= df))"""


def _asking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries some of which ask for a regulator, a type, a risk or a date, and cases that have these."""
    i = F.col("qid")
    q = _queries(spark, sf_dir).select(
        "qid", "text", F.when(i % 3 == 0, "rc1").alias("regulator"), F.when(i % 4 == 1, "en").otherwise("").alias("institution_type"),
        F.when(i % 5 == 2, "R002").alias("risk_type"), F.when(i % 6 == 3, "2024-02-01").alias("date_from"),
    )
    return q, rule_cases(spark, sf_dir).withColumn("publish_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 100).cast("int")))


@query("select qid, case_id, score, rk from " + at_k(lexical_sql(permit=PERMIT_SQL), 80))
def lexical_permitted(spark, sf_dir):
    """The lexical channel among the cases that count and that each query asks for."""
    q, c = _asking(spark, sf_dir)
    return R.lexical(q, _index(spark, sf_dir), R.DEPTH["bm25"], Permit.of(q, c)).select("qid", "case_id", "score", "rk")


@query(f"""with q as (select vec_id qid, embedding e, case when vec_id % 100 = 0 then 3 end l from embeddings where vec_id % 50 = 0),
s as (select qid, printf('C%06d', c.vec_id) case_id, round(list_cosine_similarity(e::double[], c.embedding::double[]), 6) score from q, embeddings c
  where c.vec_id % 4 > 0 and (l is null or c.label = l))
select * from (select *, row_number() over (partition by qid order by score desc, case_id) rk from s) where rk <= 200""")
def dense_permitted(spark, sf_dir):
    """Exact neighbours among the vectors that count and have the label that the query asks for."""
    q, c = _vectors(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    attributes = e.select(numbered("C", F.col("vec_id")).alias("case_id"), (F.col("vec_id") % 4 > 0).alias("related"), F.col("label").cast("string").alias("regulator"))
    q = q.withColumn("regulator", F.when(F.col("qid") % 100 == 0, "3"))
    return R.dense(q, c, R.DEPTH["dense"], permit=Permit.of(q, attributes)).select("qid", "case_id", "score", "rk")



@query("""with q as (select item_id qid, ['R00' || (item_id % 5 + 1)] ids, case item_id % 3 when 0 then ['其他'] when 1 then ['夸大收益'] else [] end tags from benchmark),
default_tags as (select * from (values ('R001', '销售误导'), ('R002', '合同外利益'), ('R003', '虚假宣传'), ('R004', '代理人管理不到位'), ('R005', '虚列费用套取资金'), ('R011', '其他')) v(id, tag)),
qi as (select distinct qid, id from (select qid, unnest(ids) id from q union all select qid, case t when '其他' then 'R011' else 'R001' end from (select qid, unnest(tags) t from q))),
qt as (select qid, unnest(tags) tag from q union select qid, tag from qi join default_tags using (id)),
c as (select printf('C%06d', doc_id) case_id, (doc_id % 17)::double confidence, ['R00' || (doc_id % 8 + 1)] ids,
  case doc_id % 4 when 0 then ['销售误导'] when 1 then ['销售误导', '其他'] when 2 then [] end tags, doc_id % 10 > 0 related from documents),
m as (select qid, case_id, confidence from qi join (select *, unnest(ids) id from c where related) using (id)
  union all select qid, case_id, confidence from qt join (select *, unnest(tags) tag from c where related) using (tag))
select qid, case_id, score, rk from (select qid, case_id, count(*)::double score, row_number() over (partition by qid order by count(*) desc, max(confidence) desc, case_id) rk from m group by qid, case_id) where rk <= 80""")
def tag_channel(spark, sf_dir):
    """Common risk ids and tags, each filled up from the other."""
    i = F.col("doc_id")
    tags = F.when(i % 4 == 0, F.array(F.lit("销售误导"))).when(i % 4 == 1, F.array(F.lit("销售误导"), F.lit("其他"))).when(i % 4 == 2, F.array().cast("array<string>"))
    c = table(spark, sf_dir, "documents").select(
        numbered("C", i).alias("case_id"), (i % 17).cast("double").alias("confidence"), F.array(F.concat(F.lit("R00"), (i % 8 + 1).cast("string"))).alias("risk_type_ids"),
        tags.alias("risk_tags"), (i % 10 > 0).alias("related"),
    )
    n = F.col("qid")
    asked = F.when(n % 3 == 0, F.array(F.lit("其他"))).when(n % 3 == 1, F.array(F.lit("夸大收益"))).otherwise(F.array().cast("array<string>"))
    q = _queries(spark, sf_dir).select("qid", F.array(F.concat(F.lit("R00"), (n % 5 + 1).cast("string"))).alias("risk_ids"), asked.alias("tags"))
    return R.tag_channel(q, c, R.DEPTH["tag"], Permit.of(q, c)).select("qid", "case_id", "score", "rk")


def _channels(spark, sf_dir):
    lex = R.lexical(_queries(spark, sf_dir), _index(spark, sf_dir), R.DEPTH["bm25"]).select("qid", F.lit("bm25").alias("channel"), "case_id", "score", "rk")
    spa = R.sparse(*_sparse_inputs(spark, sf_dir), R.DEPTH["sparse"]).select("qid", F.lit("sparse").alias("channel"), "case_id", "score", "rk")
    return lex.unionByName(spa)


CHANNELS_SQL = f"""(select qid, 'bm25' channel, case_id, score, rk from {at_k(LEXICAL_SQL, 80)} union all
  select qid, 'sparse', case_id, score, rk from {at_k(SPARSE_SQL, 100)})"""
RRF_SQL = f"""(select *, row_number() over (partition by qid order by score desc, case_id) rk from (
  select qid, case_id, round(sum(case channel when 'bm25' then 1.15::double else 1.0::double end / (60.0::double + rk))
    + case when count(distinct channel) > 1 then 0.05::double * (count(distinct channel) - 1) else 0::double end, 6) score,
    array_to_string(list_sort(list_distinct(list(channel))), ',') channels
  from {CHANNELS_SQL} group by qid, case_id))"""


@query(f"select qid, case_id, score, channels, rk from {RRF_SQL} where rk <= 10")
def rrf_fusion(spark, sf_dir):
    return R.rrf(_channels(spark, sf_dir), 10).select("qid", "case_id", "score", F.array_join("channels", ",").alias("channels"), "rk")


MERGE_ROWS = [
    ("q", "dense_raw", "A", 0.5, 1), ("q", "dense_raw", "B", 0.4, 2), ("q", "dense", "A", 0.9, 1), ("q", "dense", "C", 0.8, 2),
    ("q", "dense_hyde", "D", 0.3, 1), ("q", "sparse", "E", 7.0, 1), ("q", "sparse", "A", 6.0, 2), ("q", "sparse", "F", 5.0, 3),
]


@query(f"""with c as {values('qid, channel, case_id, score, rk', MERGE_ROWS)},
d as (select qid, case_id, max(score) score, 0 part from c where channel <> 'sparse' group by all),
s as (select qid, case_id, score, 1 part from c where channel = 'sparse' and case_id not in (select case_id from d))
select qid, case_id, score, row_number() over (partition by qid order by part, score desc, case_id) rk from (select * from d union all select * from s)""")
def max_merge_fusion(spark, sf_dir):
    c = rows(spark, "qid string, channel string, case_id string, score double, rk int", MERGE_ROWS)
    return R.max_merge(c, 200).select("qid", "case_id", "score", "rk")


ORDERS = [("a", ["C", "A", "Z"]), ("b", ["E", "D", "C", "B", "A"]), ("c", [])]


@query(values("qid, case_id, rk", [("a", "C", 1), ("a", "A", 2), ("a", "B", 3), ("b", "E", 1), ("b", "D", 2), ("b", "C", 3), ("b", "B", 4), ("c", "A", 1), ("c", "B", 2), ("c", "C", 3), ("c", "D", 4)]).replace("(select * from", "select qid, case_id, rk from (select * from"))
def listwise_order(spark, sf_dir):
    c = rows(spark, "qid string, case_id string, score double, rk int", [(q, x, 1.0 - i / 10, i + 1) for q, _ in ORDERS for i, x in enumerate("ABCDE")])
    return R.listwise(c, rows(spark, "qid string, ids array<string>", ORDERS), 3, 4).select("qid", "case_id", "rk")


def _first_tokens(key: str, source: str, text: str, limit: int) -> str:
    """SQL for the first distinct tokens of a text in their order: (key, ts)."""
    return f"""(select k, list(t order by i)[1:{limit}] ts from (select k, t, min(i) i from (select {key} k, unnest(x) t, generate_subscripts(x, 1) i
      from (select *, regexp_extract_all({text}, {TOKEN_SQL}) x from {source})) group by all) group by k)"""


@query(rf"""with r as (select qid, case_id, score, channels from {RRF_SQL} where rk <= 5),
c as (select printf('C%06d', doc_id) case_id, regexp_replace(case when doc_id % 11 = 0 then '' else text end, '^\s+|\s+$', '', 'g') vb, case when doc_id % 3 = 0 then '' else source end p,
  case when doc_id % 2 = 0 then 'N' || doc_id end no, case when doc_id % 5 = 0 then '命中规则词典：x。' else 'x' end reason, case when lang = 'en' then [] else [lang] end tags from documents),
q as {_first_tokens('item_id', 'benchmark', r"regexp_replace(text, '^\s+|\s+$', '', 'g')", 40)},
d as {_first_tokens('case_id', 'c', "vb || ' ' || p", 80)},
j as (select r.qid, r.case_id, r.score, channels, vb, p, no, reason, tags, list_filter(coalesce(d.ts, []), lambda x: list_contains(coalesce(q.ts, []), x))[1:4] common
  from r join c using (case_id) left join q on q.k = qid left join d on d.k = r.case_id)
select qid, case_id, concat_ws('；', case when starts_with(reason, '命中规则词典') then regexp_replace(reason, '[；;。]+$', '') end,
  case when len(common) > 0 then '共同线索：' || array_to_string(common, '、') when vb <> '' then '对照违法事实：' || case when length(vb) > 48 then substr(vb, 1, 48) || '…' else vb end end,
  case when len(tags) > 0 then '共有风险标签：' || tags[1] end, case when p <> '' then '处罚结果：' || p when no is not null then '处罚文号：' || no end,
  '召回通道：' || replace(replace(replace(channels, ',', '、'), 'bm25', '关键词'), 'sparse', '稀疏词项')) || '。' reason from j""")
def match_reason(spark, sf_dir):
    best = R.rrf(_channels(spark, sf_dir), 5).select("qid", "case_id", "score", "channels")
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        numbered("C", i).alias("case_id"), F.when(i % 11 == 0, "").otherwise(F.col("text")).alias("violation_behavior"),
        F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("penalty_content"), F.when(i % 2 == 0, F.concat(F.lit("N"), i.cast("string"))).alias("penalty_doc_no"),
        F.when(i % 5 == 0, "命中规则词典：x。").otherwise("x").alias("reason"), F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang")).alias("risk_tags"),
    )
    joined = d.join(best, "case_id").join(_queries(spark, sf_dir), "qid")
    names = ["case_id", "score", "reason", "violation_behavior", "penalty_content", "penalty_doc_no", "risk_tags", "channels"]
    return joined.select("qid", "case_id", R.match_reason(F.col("text"), {n: F.col(n) for n in names}).alias("reason"))


def _near_sql(side: str, channel: str) -> str:
    return f"""(select *, row_number() over (partition by qid order by score desc, case_id) rk from (
      select q.qid, c.case_id, '{channel}' channel, round(sum(q.w * c.w) / (max(q.n) * max(c.n)), 6) score from {side} q join cv c using (b) group by all
      union all select q.qid, c.case_id, '{channel}', 0.0 from (select distinct qid from {side}) q, (select distinct case_id from cv) c
        where not exists (select 1 from {side} x join cv y using (b) where x.qid = q.qid and y.case_id = c.case_id)) qualify rk <= 200)"""


def _vector_sql(key: str, source: str) -> str:
    return f"""(select {key}, b, w, sqrt(sum(w * w) over (partition by {key})) n from (
      select {key}, ('0x' || substr(md5(token), 1, 8))::bigint % 64 b, sum(w) w from {source} group by all))"""


def _count_sql(key: str, text: str, source: str) -> str:
    return f"(select {key}, token, count(*)::double w from (select {key}, unnest(regexp_extract_all(lower({text}), {TOKEN_SQL})) token from {source}) group by all)"


E2E_SQL = f"""
with asked as materialized (select item_id qid, text, text || coalesce((select ' ' || array_to_string(list_slice(list_sort(list_distinct(list(standard_term))), 1, 10), ' ')
    from {SYN_SQL} s where b.text like concat('%', business_term, '%') having count(*) > 0), '') rewrite from benchmark b),
ct as materialized {_count_sql('case_id', 'text', "(select printf('C%06d', doc_id) case_id, text from documents)")},
rt as materialized {_count_sql('qid', 'rewrite', 'asked')}, qt as materialized {_count_sql('qid', 'text', 'asked')},
cv as materialized {_vector_sql('case_id', 'ct')}, rv as materialized {_vector_sql('qid', 'rt')}, qv as materialized {_vector_sql('qid', 'qt')},
near as materialized (select * from {_near_sql('rv', 'dense')} union all select * from {_near_sql('qv', 'dense')}),
sp as (select *, row_number() over (partition by qid order by score desc, case_id) rk from (
  select qid, case_id, round(sum(rt.w * ct.w), 6) score from rt join ct using (token) group by all) qualify rk <= 100),
d as (select *, row_number() over (partition by qid order by score desc, case_id) rk from (select qid, case_id, max(score) score from near group by all) qualify rk <= 200),
s as (select sp.qid, sp.case_id, row_number() over (partition by sp.qid order by sp.score desc, sp.case_id) rk from sp anti join d using (qid, case_id) qualify rk <= 20),
m as (select qid, case_id, row_number() over (partition by qid order by part, rk) recall_rank, case when part = 1 then 'sparse' when exists (select 1 from sp where sp.qid = u.qid and sp.case_id = u.case_id) then 'dense,sparse' else 'dense' end channels
  from (select qid, case_id, rk, 0 part from d union all select qid, case_id, rk, 1 from s) u qualify recall_rank <= 200),
qs as (select item_id qid, list_distinct(regexp_extract_all(lower(text), {TOKEN_SQL})) ts from benchmark),
ds as (select printf('C%06d', doc_id) case_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 1200)), {TOKEN_SQL})) ts from documents),
r as (select m.*, round(len(list_intersect(qs.ts, ds.ts)) / greatest(len(qs.ts), 1)::double, 6) score from m join qs using (qid) join ds using (case_id))
select qid, case_id, score, channels, row_number() over (partition by qid order by score desc, recall_rank) rk from r qualify rk <= 10"""


@query(E2E_SQL)
def retrieve_e2e(spark, sf_dir):
    """Batch retrieval by the default backend: dense on both wordings, sparse, max-merge, rerank, best 10."""
    def rewrite(queries: DataFrame) -> DataFrame:
        terms = R.expand_synonyms(queries, _synonyms(spark))
        return terms.select("qid", "text", F.when(F.col("expansion") != "", F.concat_ws(" ", "text", "expansion")).alias("rewrite"))

    found = Backend(rewrite=rewrite).retrieve(_queries(spark, sf_dir), _corpus(spark, sf_dir))
    return found.select("qid", "case_id", "score", F.array_join("channels", ",").alias("channels"), "rk")


GOLD_SQL = "(select item_id qid, printf('C%06d', doc_id) case_id from benchmark b join documents d on contains(d.text, b.text))"


def gold(spark, sf_dir):
    """Relevant documents of an item: those that contain its text."""
    return _corpus(spark, sf_dir).alias("d").join(small(_queries(spark, sf_dir)).alias("b"), F.expr("contains(d.text, b.text)")).select("qid", "case_id")


@query(f"select * from {GOLD_SQL}")
def gold_containment(spark, sf_dir):
    return gold(spark, sf_dir)


METRICS_SQL = f"""
with g as {GOLD_SQL}, r as (select qid, case_id, rk from {RRF_SQL} where rk <= 10),
n as (select qid, count(*) n_rel from g group by qid),
m as (select n.qid, n_rel, min(r.rk) first_rank, count(case when r.rk <= 3 then 1 end) hit3, count(r.rk) hit10,
  sum(1.0::double / log2(r.rk + 1.0)) dcg from n left join (select r.* from r join g using (qid, case_id)) r using (qid) group by all),
i as (select qid, sum(1.0::double / log2(k + 1.0)) ideal from (select qid, unnest(range(1, least(n_rel, 10) + 1)) k from n) group by qid)
select count(*) n_queries, round(avg(coalesce(1.0::double / first_rank, 0)), 6) mrr, round(avg(case when first_rank = 1 then 1.0 else 0.0 end::double), 6) top1,
  round(avg(hit3 / n_rel::double), 6) recall3, round(avg(hit10 / n_rel::double), 6) recall10, round(avg(coalesce(dcg, 0) / ideal), 6) ndcg10
from m join i using (qid)"""


@query(METRICS_SQL)
def retrieval_metrics(spark, sf_dir):
    """Macro means of reciprocal rank, first hit, recall and NDCG of the fused ranking."""
    from docketry.operators.metrics import ranking_metrics

    ranked = R.rrf(_channels(spark, sf_dir), 10).select("qid", "case_id", "rk")
    per = ranking_metrics(ranked, gold(spark, sf_dir).withColumn("gain", F.lit(1.0)), 10)
    mean = lambda c, name: rounded(F.avg(c)).alias(name)
    return per.agg(F.count("*").alias("n_queries"), mean("mrr", "mrr"), mean("top1", "top1"), mean("recall3", "recall3"), mean("recall10", "recall10"), mean("ndcg", "ndcg10"))
