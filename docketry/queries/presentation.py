"""Presentation of found cases and tolerant reading of model answers, over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import answers as A
from docketry.functions import insights as I
from docketry.functions import text as T
from docketry.queries.base import query, rows, table, values

#: Phrases of the trade, two of which make a query; the test tables have none of their own.
PHRASES = ["营销话术", "赠送礼品", "保本无风险", "夸大收益误导", "培训说明会", "返佣补贴", "合同条款", "普通内容", "体检卡加油卡", "无"]
ASKED_SQL = f"(select doc_id, [{', '.join(map(repr, PHRASES))}][doc_id % 10 + 1] || '，' || [{', '.join(map(repr, PHRASES))}][(doc_id // 10) % 10 + 1] q, source, lang, text from documents)"


def asked(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    phrase = lambda n: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (n % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(phrase(i), F.lit("，"), phrase(F.floor(i / 10))).alias("q"), "source", "lang", "text")


def _list(values_: list[str]) -> str:
    return "[" + ", ".join(map(repr, values_)) + "]"


def _labels_sql(q: str, hints: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({q}, {p!r}) then {label!r} end" for p, label in hints) + "], lambda x: x is not null)"


def _keywords_sql(q: str, most: int) -> str:
    found = f"list_filter({_list(I.POOL)}, lambda k: contains({q}, k))"
    pieces = f"list_filter(list_transform(string_split_regex({q}, '[，。；、！？\\s]+'), lambda p: trim(p)), lambda p: length(p) between 2 and 8)"
    both = f"list_concat({found}, {pieces})"
    return f"(case when len({found}) >= 2 then {found} else list_filter({both}, lambda x, i: list_position({both}, x) = i) end)[1:{most}]"


@query(f"""select doc_id, coalesce({_labels_sql('q', I.SCENES)}[1], {I.NO_SCENE!r}) scene,
  array_to_string(case when len({_labels_sql('q', I.BEHAVIOURS)}) > 0 then {_labels_sql('q', I.BEHAVIOURS)}[1:3] when len({_keywords_sql('q', 2)}) > 0 then {_keywords_sql('q', 2)} else [{I.NO_BEHAVIOUR!r}] end, '|') behaviours,
  coalesce({_labels_sql('q', I.RISKS)}[1], nullif(array_to_string({_keywords_sql('q', 2)}, ' / '), ''), {I.NO_RISK!r}) risk, array_to_string({_keywords_sql('q', 4)}, '|') keywords from {ASKED_SQL}""")
def query_insights(spark, sf_dir):
    """What a query is about: scene, behaviour, risk, key words."""
    q = F.col("q")
    return asked(spark, sf_dir).select(
        "doc_id", I.business_scene(q).alias("scene"), F.array_join(I.behaviour_elements(q), "|").alias("behaviours"), I.risk_description(q).alias("risk"), F.array_join(I.risk_keywords(q), "|").alias("keywords")
    )


REASON_SQL = "(case when doc_id % 3 = 0 then '业务场景一致；' || source || '号文件；短；' || lang || '语种处罚。' when doc_id % 3 = 1 then '高度近似' end)"
FACTS_SQL = f"list_filter(list_transform(string_split_regex(regexp_replace(coalesce({REASON_SQL}, ''), '{I.SET_PHRASES}', '', 'g'), '[；;。]'), lambda x: trim(x)), lambda x: length(x) >= 4)[1:6]"
MISSED_SQL = f"list_filter({_keywords_sql('q', 6)}, lambda k: not contains([{', '.join(map(repr, PHRASES))}][doc_id % 10 + 1] || text, k))[1:3]"


@query(f"""select doc_id, array_to_string({FACTS_SQL}, '|') facts, array_to_string({MISSED_SQL}, '|') missed,
  case when len({MISSED_SQL}) > 0 then {I.DIFFERENCE[0]!r} || array_to_string({MISSED_SQL}, '、') || {I.DIFFERENCE[1]!r} else coalesce({FACTS_SQL}[1], {I.NO_DIFFERENCE!r}) end note from {ASKED_SQL}""")
def match_facts(spark, sf_dir):
    """Facts of a reason, key words that a case lacks, and the note on the difference."""
    i, q = F.col("doc_id"), F.col("q")
    reason = F.when(i % 3 == 0, F.concat(F.lit("业务场景一致；"), "source", F.lit("号文件；短；"), "lang", F.lit("语种处罚。"))).when(i % 3 == 1, "高度近似")
    corpus = F.concat(F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i % 10 + 1).cast("int")), "text")
    return asked(spark, sf_dir).select(
        "doc_id", F.array_join(I.match_facts(reason), "|").alias("facts"), F.array_join(I.missed_keywords(q, corpus), "|").alias("missed"), I.difference_note(q, corpus, reason).alias("note")
    )


@query(r"""with t as (select doc_id, case when doc_id % 4 = 0 then ' ' else regexp_replace(text, '^\s+|\s+$', '', 'g') end b, case when doc_id % 3 = 0 then null else source end p from documents),
h as (select *, coalesce(nullif(trim(b), ''), nullif(p, ''), 'C' || doc_id) raw from t),
c as (select *, coalesce(nullif(regexp_replace(string_split_regex(raw, '[。；;\n]')[1], '^\s+|\s+$', '', 'g'), ''), raw) one from h)
select doc_id, case when length(one) > 52 then substr(one, 1, 52) || '…' else one end headline, coalesce(nullif(p, ''), nullif(trim(b), ''), '暂无处罚结果摘要') penalty from c""")
def case_headlines(spark, sf_dir):
    """First clause of what there is of a case, and its penalty or what stands for it."""
    i = F.col("doc_id")
    behaviour, penalty = F.when(i % 4 == 0, " ").otherwise(F.col("text")), F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("source"))
    name = F.concat(F.lit("C"), i.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", I.case_headline(behaviour, penalty, name).alias("headline"), I.penalty_highlight(penalty, behaviour).alias("penalty"))


TERMS = ["the", "th", "and", "en", "x"]


@query("""select doc_id, len(regexp_extract_all(text, 'the|and|th|en')) n_hits, coalesce(list_sum(list_transform(regexp_extract_all(text, 'the|and|th|en'), lambda x: length(x))), 0)::bigint hit_chars, text whole from documents""")
def highlight_segments(spark, sf_dir):
    """Texts cut at the longest terms: the pieces together are the text again."""
    parts = I.highlighted(F.col("text"), TERMS)
    d = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    hit = F.filter("parts", lambda p: p["hit"])
    chars = F.aggregate(F.transform(hit, lambda p: F.length(p["text"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size(hit).cast("long").alias("n_hits"), chars.alias("hit_chars"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("whole"))


@query(r"""select p_partkey, '〔' || p_partkey || '〕' || replace(p_type, ' ', '') || '（' || p_size || '）' number,
  substr(regexp_replace(regexp_replace(p_name || ': ' || p_brand || '?.', '[<>:"/\\|?*\s]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) file from part""")
def names_and_numbers(spark, sf_dir):
    """Numbers with one kind of brackets; names that any file system takes."""
    number = F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit("] "), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.plain_brackets(number).alias("number"), T.safe_file_name(F.concat("p_name", F.lit(": "), "p_brand", F.lit("?."))).alias("file"))


@query("""select c_custkey, case when c_custkey % 4 <> 3 then strftime(date '2020-01-01' + (c_custkey % 900)::int, '%Y-%m-%d') end on_day, array_to_string(case when length(c_name) between 4 and 24 then [c_name] else [] end, '|') phrases, c_mktsegment target from customer""")
def dates_and_phrases(spark, sf_dir):
    """Dates in four writings, phrases in quotation marks, and what a boundary refers to."""
    i = F.col("c_custkey")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int"))
    y, m, day = F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    said = F.when(i % 4 == 0, F.concat(F.lit("于 "), y, F.lit(" 年"), m, F.lit("月 "), day, F.lit("日"))).when(i % 4 == 1, F.concat_ws("/", y, m, day)).when(i % 4 == 2, F.concat_ws(".", y, m, day)).otherwise("无")
    typical = F.concat(F.lit("如“"), "c_name", F.lit("”、「保本」、“"), "c_name", F.lit("”，"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.loose_date(said).alias("on_day"), F.array_join(T.quoted_phrases(typical), "|").alias("phrases"), T.redirects(F.concat(F.lit("否则归入"), "c_mktsegment", F.lit("；")))[0].alias("target")
    )


ANSWERS = [
    (1, '```json\n{"order": ["A"]}\n```', '{"order": ["A"]}', None), (2, 'Sure: {"order": ["B"]} done', '{"order": ["B"]}', None), (3, "[1, 2]", None, None), (4, "no json", None, None),
    (5, None, None, None), (6, '{"cases": [{"party": "甲"}, {"party": "乙"}]}', '{"cases": [{"party": "甲"}, {"party": "乙"}]}', "甲|乙"),
    (7, '[{"party": "丙"}]', '{"party": "丙"}', "丙"), (8, '```\n{"party": "丁"}\n```', '{"party": "丁"}', "丁"), (9, '{"party": "x"', None, None),
]


@query(f"select id, object, parties from {values('id, object, parties', [(r[0], r[2], r[3] or '') for r in ANSWERS])}")
def model_answers(spark, sf_dir):
    """Objects and items in model answers, fenced, surrounded, wrapped or broken: expected values by hand."""
    d = rows(spark, "id int, answer string", [r[:2] for r in ANSWERS])
    found = F.transform(A.items(F.col("answer"), "struct<party: string>"), lambda x: x["party"])
    return d.select("id", A.json_object(F.col("answer")).alias("object"), F.array_join(F.filter(found, lambda x: x.isNotNull()), "|").alias("parties"))


@query("select s_suppkey, list_sort(list_filter(['a', case when s_suppkey % 3 <> 0 then 'b' end], lambda x: x is not null)) tokens, case when s_suppkey % 3 = 0 then 1.5::double else 1.5::double + s_suppkey % 3 end total from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, [], 0.0::double from supplier where s_suppkey % 5 = 0")
def sparse_weights(spark, sf_dir):
    """Sparse vectors read from JSON: zeros go, text that is no map is empty."""
    i = F.col("s_suppkey")
    said = F.when(i % 5 == 0, "[]").otherwise(F.concat(F.lit('{"a": 1.5, "b": '), (i % 3).cast("string"), F.lit(', "c": 0}')))
    v = A.sparse_vector(said)
    total = F.aggregate(F.map_values("v"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", F.array_sort(F.map_keys("v")).alias("tokens"), total.alias("total"))
