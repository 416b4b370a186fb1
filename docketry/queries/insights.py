"""Presentation analytics and smaller operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import insights as I
from docketry.functions.text import clip
from docketry.operators import tables as T
from docketry.operators.checks import small
from docketry.queries.base import query, rounded, rows, table, values
from docketry.sources.export import cells, split_valid
from docketry.sources.files import MIME, best_attempt, mime_of


@query("""select p_partkey, round(least(100, greatest(0, p_size / 50.0::double * 100)), 1) pct,
  case when round(least(100, greatest(0, p_size / 50.0::double * 100)), 1) >= 70 then '高度相关' when round(least(100, greatest(0, p_size / 50.0::double * 100)), 1) >= 45 then '相关' else '一般相关' end tier from part""")
def relevance_tiers(spark, sf_dir):
    score = F.col("p_size") / F.lit(50.0)
    return table(spark, sf_dir, "part").select("p_partkey", I.relevance_percent(score).alias("pct"), I.relevance_tier(score).alias("tier"))


LEVELS = [("0.9", 0.9, "high"), ("75%", 0.75, "mid"), ("high", 0.95, "high"), (" Medium ", 0.75, "mid"), ("low", 0.45, "low"), ("120", 1.0, "high"), ("x", None, "low"), (None, None, "low"), ("-3", 0.0, "low")]


@query(f"select * from {values('raw, value, tier', LEVELS)}")
def confidence_tiers(spark, sf_dir):
    c = I.normal_confidence(F.col("raw"))
    return rows(spark, "raw string", [r[:1] for r in LEVELS]).select("raw", c.alias("value"), I.confidence_tier(c).alias("tier"))


@query("""select bucket, count(*) n from (select case when m < 1 then 'now' when m < 60 then 'minutes' when m < 1440 then 'hours' when m < 2880 then 'yesterday' when m < 10080 then 'days' else 'date' end bucket
  from (select date_diff('second', ts, (select max(ts) from events)) // 60 m from events)) group by 1""")
def age_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    minutes = F.floor((F.unix_timestamp("last") - F.unix_timestamp("ts")) / 60)
    return e.crossJoin(F.broadcast(last)).groupBy(I.age_bucket(minutes).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select doc_id, replace(text, 'the', '<mark>the</mark>') marked, case when instr(text, 'the') > 0 then
  case when greatest(1, instr(text, 'the') - 28) > 1 then '…' else '' end || substr(text, greatest(1, instr(text, 'the') - 28)::bigint, (least(length(text), instr(text, 'the') + 2 + 28) - greatest(1, instr(text, 'the') - 28) + 1)::bigint)
  || case when least(length(text), instr(text, 'the') + 2 + 28) < length(text) then '…' else '' end end snippet from documents""")
def highlights(spark, sf_dir):
    the = F.lit("the")
    return table(spark, sf_dir, "documents").select("doc_id", I.marked(F.col("text"), the).alias("marked"), I.snippet(F.col("text"), the).alias("snippet"))


@query("""select r_name, n_name, n, sum(n) over (partition by r_name)::bigint total, round(sqrt(n / greatest(max(n) over (partition by r_name), 1)::double), 6) size
  from (select r_name, n_name, count(*) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)""")
def atlas_rollup(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    tree = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return I.atlas(n.join(tree, "n_nationkey"), "r_name", "n_name", "n").select("r_name", "n_name", "n", "total", "size")


@query("""select s_suppkey::varchar s_suppkey, s_name, s_acctbal_text, tags, meta from (select s_suppkey, s_name, case when s_suppkey % 7 = 0 then '' else (floor(s_acctbal)::bigint)::varchar end s_acctbal_text,
  'a、' || s_nationkey tags, '{"k":"' || s_nationkey || '"}' meta from supplier)""")
def table_export(spark, sf_dir):
    """Cells as an export writes them: blanks for nulls, joined lists, maps as JSON."""
    s = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    shown = F.when(F.col("s_suppkey") % 7 != 0, F.floor("s_acctbal").cast("bigint"))
    return cells(s.select("s_suppkey", "s_name", shown.alias("s_acctbal_text"), F.array(F.lit("a"), nation).alias("tags"), F.create_map(F.lit("k"), nation).alias("meta")))


@query("""select i, tip from (select row_number() over (order by p_partkey) i, p_partkey, '- ' || case when length(p_name) > 90 then substr(p_name, 1, 90) || '…' else p_name end tip,
  from part), lateral (select 1) qualify sum(length(tip) + 1) over (order by i) <= 3500 and i <= 27""")
def tag_guide(spark, sf_dir):
    """Lines of a guide until it is 3,500 characters long, 27 at most."""
    line = F.concat(F.lit("- "), clip(F.col("p_name"), 90))
    p = table(spark, sf_dir, "part").orderBy("p_partkey").limit(27).select("p_partkey", line.alias("tip"))
    w = Window.orderBy("p_partkey")  # over at most 27 rows
    p = p.withColumn("i", F.row_number().over(w)).withColumn("used", F.sum(F.length("tip") + 1).over(w))
    return p.where("used <= 3500").select("i", "tip")


ATTEMPTS = [(1, 0.6, 0.9, 0.9, "table"), (2, 0.2, 0.7, 0.9, "text"), (3, 0.2, 0.1, 0.8, "ocr"), (4, 0.2, 0.1, None, "text")]


@query(f"select * from {values('id, chosen', [(r[0], r[4]) for r in ATTEMPTS])}")
def parse_cascade(spark, sf_dir):
    """The first parse attempt good enough, else the last there is."""
    d = rows(spark, "id int, a double, b double, c double", [r[:4] for r in ATTEMPTS])
    made = lambda col, n: F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("confidence"), F.lit(n).alias("how")))
    return d.select("id", best_attempt(made("a", "table"), made("b", "text"), made("c", "ocr"))["how"].alias("chosen"))


ENDINGS = [".HTML", ".pdf", ".tar.docx", ".PPTX", ".txt", ".jsonl", ".exe", ""]


@query(f"""with n as (select page_id, 'p' || page_id || [{', '.join(repr(x) for x in ENDINGS)}][page_id % {len(ENDINGS)} + 1] f from pages)
select page_id, case when lower(f) like '%.html' then 'text/html' when lower(f) like '%.pdf' then 'application/pdf' when lower(f) like '%.txt' then 'text/plain'
  when lower(f) like '%.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  when lower(f) like '%.pptx' then 'application/vnd.openxmlformats-officedocument.presentationml.presentation' when lower(f) like '%.jsonl' then {repr(MIME["jsonl"]) if "jsonl" in MIME else "null"} end mime from n""")
def mime_router(spark, sf_dir):
    """File names of every kind, unknown endings and none among them."""
    i = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (i % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", mime_of(F.concat(F.lit("p"), i.cast("string"), ending)).alias("mime"))


@query("""select q.n_name, count(*) n, round(sum(o_totalprice), 2) total from nation q join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
  where (n_regionkey <> 1 or o_orderpriority = '1-URGENT') and (n_regionkey <> 2 or o_orderdate >= timestamp '1996-01-01') group by 1""")
def guarded_filters(spark, sf_dir):
    """Filters of each query that count only where the query asks for them."""
    asked = table(spark, sf_dir, "nation").select(
        "n_name", "n_nationkey", F.when(F.col("n_regionkey") == 1, "1-URGENT").alias("priority"), F.when(F.col("n_regionkey") == 2, F.lit("1996-01-01").cast("timestamp")).alias("since")
    )
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fits = (F.col("priority").isNull() | (F.col("o_orderpriority") == F.col("priority"))) & (F.col("since").isNull() | (F.col("o_orderdate") >= F.col("since")))
    return o.join(small(asked), F.col("c_nationkey") == F.col("n_nationkey")).where(fits).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select printf('SYN%03d', row_number() over (order by item_id, i)) query_id, item_id, line from (select item_id, unnest(l) line, generate_subscripts(l, 1) i from (
  select item_id, list_transform(regexp_split_to_array(text, '[.;]'), lambda x: trim(x)) l from benchmark)) where length(line) >= 8""")
def synthetic_queries(spark, sf_dir):
    """Lines of at least eight characters, numbered."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.transform(F.split("text", "[.;]"), lambda x: F.trim(x))).alias("i", "line"))
    lines = lines.where(F.length("line") >= 8).withColumn("at", F.struct("item_id", "i"))
    existing = spark.createDataFrame([], "query_id string")
    out = T.allocate(lines, existing, "query_id", "SYN", "at")
    return out.select(F.format_string("SYN%03d", F.substring("query_id", 4, 18).cast("long")).alias("query_id"), "item_id", "line")


@query(f"select * from {values('error, n', [('no cases', 1), ('ok', 2), ('question_id missing', 1), ('risk_type empty', 1)])}")
def submission_split(spark, sf_dir):
    s = rows(spark, "question_id string, risk_type string, case_ids array<string>", [("q1", "x", ["C1"]), (None, "x", ["C3"]), ("q2", "", ["C4"]), ("q3", "x", []), ("q4", "x", ["C5"])])
    good, bad = split_valid(s)
    return good.select(F.lit("ok").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").cast("int").alias("n"))


@query("select count(*) n, round(avg(value), 6) mean, min(event_id) first_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(c, "user_id", "left_semi").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), F.min("event_id").alias("first_id"))
