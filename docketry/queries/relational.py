"""Lists, counts, merges and exports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import fine_value, numbered, parse_date
from docketry.operators import tables as T
from docketry.queries.base import CASES_SQL, cases, query, rounded, rows, table, values


@query(f"select case_id, regulator, institution_type from {CASES_SQL} where related and regulator ilike '%RC1%' and institution_type = 'en' order by regulator desc nulls last, case_id limit 20 offset 20")
def case_list_page(spark, sf_dir):
    found = T.apply_filter(cases(spark, sf_dir), T.CaseFilter(queue="confirmed", regulator="RC1", institution_type="en"))
    return T.page(found, "regulator", True, 2, 20, "case_id").select("case_id", "regulator", "institution_type")


@query(f"select count(*) total from {CASES_SQL} where related and list_contains(regexp_extract_all(lower(violation_behavior), '[一-鿿]{{2,8}}|[A-Za-z0-9]{{2,}}'), 'the')")
def case_list_total(spark, sf_dir):
    return T.apply_filter(cases(spark, sf_dir), T.CaseFilter(queue="confirmed", keyword="the")).agg(F.count("*").alias("total"))


FINE_SQL = """(select o_orderkey, case o_orderkey % 4 when 0 then '罚款' || round(o_totalprice / 10000)::bigint || '万元' when 1 then round(o_totalprice / 1000)::bigint || '千元'
  when 2 then round(o_totalprice)::bigint || '元' end fine from orders)"""


@query(f"""select o_orderkey, fine, fine_value from (select *, coalesce(try_cast(regexp_replace(fine, '[^0-9.]', '', 'g') as double), 0)
  * case when contains(fine, '万') then 10000.0 when contains(fine, '千') then 1000.0 else 1.0 end::double fine_value from {FINE_SQL})
  order by fine_value desc, o_orderkey limit 50 offset 50""")
def fine_sort(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    whole = lambda d: F.round(F.col("o_totalprice") / d).cast("long").cast("string")
    kind = F.col("o_orderkey") % 4
    fine = F.when(kind == 0, F.concat(F.lit("罚款"), whole(10000), F.lit("万元"))).when(kind == 1, F.concat(whole(1000), F.lit("千元"))).when(kind == 2, F.concat(whole(1), F.lit("元")))
    best = T.page(o.select("o_orderkey", fine.alias("fine_amount")), "fine_amount", True, 2, 50, "o_orderkey")
    return best.select("o_orderkey", F.col("fine_amount").alias("fine"), fine_value(F.col("fine_amount")).alias("fine_value"))


@query(f"""select regulator, count(*) total, count(*) filter (where related) confirmed, count(*) filter (where candidate and not related) pending,
  count(*) filter (where not candidate and not related) excluded from {CASES_SQL} group by regulator""")
def doc_queue_counts(spark, sf_dir):
    q = T.queue_of(F.col("related"), F.col("candidate"))
    return cases(spark, sf_dir).groupBy("regulator").agg(F.count("*").alias("total"), *[F.count_if(q == n).alias(n) for n in ("confirmed", "pending", "excluded")])


@query(f"""select (select count(*) from documents) n_documents, count(*) n_cases, count(*) filter (where related) n_related, count(*) filter (where candidate and not related) n_pending,
  (select count(*) from embeddings) n_embedded, round(count(*) filter (where related and candidate) / nullif(count(*) filter (where related), 0)::double, 4) coverage from {CASES_SQL}""")
def stats_overview(spark, sf_dir):
    c = cases(spark, sf_dir).agg(
        F.count("*").alias("n_cases"), F.count_if("related").alias("n_related"), F.count_if(F.col("candidate") & ~F.col("related")).alias("n_pending"),
        F.round(F.count_if(F.col("related") & F.col("candidate")) / F.nullif(F.count_if("related"), F.lit(0)), 4).alias("coverage"),
    )
    one = lambda t, n: table(spark, sf_dir, t).agg(F.count("*").alias(n))
    return c.crossJoin(one("documents", "n_documents")).crossJoin(one("embeddings", "n_embedded"))  # one row each


@query("select tag, count(*) c from (select unnest(string_split(p_name, ' ')) tag from part) group by tag order by c desc, tag limit 40")
def tag_distribution(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "tag").limit(40)


@query("select r_name parent, n_name child, coalesce(c, 0) n from nation join region on n_regionkey = r_regionkey left join (select c_nationkey, count(*) c from customer where c_acctbal > 9000 group by 1) on c_nationkey = n_nationkey")
def tag_tree(spark, sf_dir):
    """A tree's leaves with their counts, zero where there is none."""
    counts = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(counts, "n_nationkey", "left").select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.coalesce("c", F.lit(0)).alias("n"))


@query("select event_type status, count(*) c, count(distinct user_id) users, round(avg(value), 6) mean_value from events group by event_type")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("c"), F.countDistinct("user_id").alias("users"), rounded(F.avg("value")).alias("mean_value"))


@query("""select event_id, json_extract_string(props, '$.k') k, 'extract' stage, round((2 + case when event_type = 'click' then 0.45::double else 0 end) / 5, 6) progress from events""")
def json_progress(spark, sf_dir):
    """Metadata merged with a patch, keys dropped, and the progress that its stage stands for."""
    meta = F.from_json("props", "map<string,string>")
    patch = F.create_map(F.lit("stage"), F.lit("extract"), F.lit("error"), F.lit("x"))
    e = table(spark, sf_dir, "events").withColumn("meta", T.drop_meta(T.merge_meta(meta, patch), "error"))
    status = F.when(F.col("event_type") == "click", "parsing").otherwise("pending")
    return e.select("event_id", F.col("meta")["k"].alias("k"), F.col("meta")["stage"].alias("stage"), T.progress(status, F.col("meta")["stage"]).alias("progress"))


@query("select sha256(text) digest, min(doc_id) doc_id, count(*) n from documents group by 1")
def content_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""select c_custkey, c_mktsegment, case when c_custkey % 10 = 0 then coalesce(case when c_custkey % 20 = 0 then 1.0::double end, c_acctbal) else c_acctbal end c_acctbal from customer""")
def upsert_merge(spark, sf_dir):
    """Every tenth row is written again, half of them without a value, which keeps the old one."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 20 == 0, 1.0))
    return T.upsert_keeping(old, new, "c_custkey")


@query("select s_suppkey, s_name, case when s_suppkey % 5 = 0 then 'new' else 'old' end state from supplier")
def upsert_replace(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("old").alias("state"))
    return T.upsert(old, old.where("s_suppkey % 5 = 0").withColumn("state", F.lit("new")), "s_suppkey")


@query("select p_partkey, printf('C%06d', (select max(doc_id) from documents) + row_number() over (order by p_partkey)) case_id from part")
def id_allocate(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select(numbered("C", F.col("doc_id")).alias("case_id"))
    return T.allocate(table(spark, sf_dir, "part").select("p_partkey"), existing, "case_id", "C", "p_partkey")


SEEDS = [("BLUE", "x"), ("AFRICA", "y"), ("ASIA", "z"), ("BLUE", "x")]


@query(f"select r_name name, 'seed' note from region union all select distinct name, note from {values('name, note', SEEDS)} where name not in (select r_name from region)")
def seed_antijoin(spark, sf_dir):
    old = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("seed").alias("note"))
    return T.insert_new(old, rows(spark, "name string, note string", SEEDS), "name")


@query("select o_orderkey, count(*) n from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F' group by 1")
def cascade_delete(spark, sf_dir):
    """Parents of a state go, and their children with them."""
    orders = table(spark, sf_dir, "orders")
    gone = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    left = table(spark, sf_dir, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return orders.join(gone, "o_orderkey", "left_anti").join(left.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(f"select 'CC' || regexp_replace(case_id, '^C+', '') candidate_id, regulator from {CASES_SQL} where candidate")
def export_candidates(spark, sf_dir):
    from docketry.sources.export import candidates

    return candidates(cases(spark, sf_dir)).select("candidate_id", "regulator")


@query(f"select case_id, regulator, length(violation_behavior) n from {CASES_SQL} join documents using (doc_id) where related and n_chars >= 1000")
def export_gold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return cases(spark, sf_dir).join(d, "doc_id").where("related and n_chars >= 1000").select("case_id", "regulator", F.length("violation_behavior").cast("long").alias("n"))


@query("select n_name, array_to_string(list_sort(list(s_name)), '|') keywords from nation join supplier on s_nationkey = n_nationkey group by n_name")
def export_dictionary(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "|").alias("keywords"))


DATES = [("2026-4-24",), ("2026/04/24",), ("2026.4.24",), ("2026年4月24日",), (" 2026-04-24 ",), ("not-a-date",), ("",), (None,), ("2026-13-40",)]


@query(f"select raw, d::date d from {values('raw, d', [(r[0], '2026-04-24' if i < 5 else None) for i, r in enumerate(DATES)])}")
def parse_dates(spark, sf_dir):
    return rows(spark, "raw string", DATES).select("raw", parse_date(F.col("raw")).alias("d"))


@query("select o_orderpriority, count(*) n, min(o_orderdate)::date first_day, count(*) filter (where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01') in_1997 from orders group by 1")
def date_range_filter(spark, sf_dir):
    day = F.col("o_orderdate")
    inside = (day >= F.lit("1997-01-01").cast("timestamp")) & (day < F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(day).cast("date").alias("first_day"), F.count_if(inside).alias("in_1997"))
