"""Dictionary filter, entities and tags on inline cases and on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import parties
from docketry.operators import classify as C
from docketry.queries.base import _literal, query, rows, table, values

CASES = [
    (1, "中国人寿保险股份有限公司北京分公司", "虚列费用套取资金，未按规定使用保险条款", "依据《保险法》第一百一十六条"),
    (2, "某某农村商业银行股份有限公司", "销售保险产品未双录", "保险法"),
    (3, "张三", "欺骗投保人，夸大收益", None),
    (4, "众安在线", None, ""),
    (5, "普通贸易公司", "合同纠纷", "民法典"),
    (6, None, "电话销售中承诺收益，赠送油卡，培训材料不真实", "保险销售行为管理办法"),
    (7, "泰康保险代理有限公司（分部）", "执业登记不规范，即将停售", None),
]
CASES_REL = values("id, party, behaviour, basis", CASES)


def _list(terms) -> str:
    return _literal(list(terms))


def _hits(c: str, terms) -> str:
    return f"list_filter({_list(terms)}, lambda t: contains(coalesce({c}, ''), t))"


def _score(found: str) -> str:
    m = f"list_max(list_transform({found}, lambda t: length(t)))"
    return f"(case when {m} >= 6 then 1.0 when {m} >= 4 then 0.9 when {m} >= 3 then 0.75 when {m} is not null then 0.55 else 0.0 end)::double"


def _either(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then {a} else {b} end)"


_E = _score(_either(_hits("party", C.ENTITY_TERMS), _hits("behaviour", C.ENTITY_TERMS)))
_B = _score(_hits("(coalesce(behaviour, '') || ' ' || coalesce(party, '') || ' ' || coalesce(basis, ''))", C.BUSINESS_TERMS))
_R = _score(_either(_hits("basis", C.REGULATORY_TERMS), _hits("behaviour", C.REGULATORY_TERMS)))


@query(f"""select id, entity, business, regulatory, excluded, final, final >= 0.5 and excluded = 0 is_insurance,
  entity + business + regulatory > 0 and excluded = 0 is_candidate from (
  select *, round(entity * 0.4::double + business * 0.35::double + regulatory * 0.25::double, 6) final from (
  select id, {_E} entity, {_B} business, {_R} regulatory, {_score(_hits('party', C.EXCLUDE_TERMS))} excluded from {CASES_REL}))""")
def dictionary_filter(spark, sf_dir):
    d = rows(spark, "id int, party string, behaviour string, basis string", CASES)
    return d.select("id", *[c.alias(n) for n, c in C.dictionary_scores(F.col("party"), F.col("behaviour"), F.col("basis")).items()])


NAMES = [("中国人寿保险股份有限公司北京分公司",), ("平安财产保险股份有限公司",), ("华泰保险经纪有限公司",), ("李四光",), ("贸易公司（深圳）",), ("",)]
_KIND = f"""(case when regexp_matches(name, '{C.AGENCY}') then '保险代理中介' when regexp_matches(name, '{C.BRANCH}') and regexp_matches(name, '{C.COMPANY}') then '保险分支机构'
  when regexp_matches(name, '{C.COMPANY}') then '保险公司' when regexp_matches(name, '{C.PERSON}') then '责任人员' else '第三方主体' end)"""


@query(f"""select name, {_KIND} kind, (case {_KIND} when '责任人员' then 0.7 when '第三方主体' then 0.5 else 0.9 end)::double confidence,
  coalesce(nullif(regexp_replace(name, '[\\s（(].*?[）)]?$', ''), ''), name) plain from {values('name', NAMES)}""")
def entity_normalize(spark, sf_dir):
    d = rows(spark, "name string", NAMES)
    n = F.col("name")
    return d.select("name", C.entity_type(n).alias("kind"), C.entity_confidence(n).alias("confidence"), C.normalized_name(n).alias("plain"))


@query("select s_suppkey, unnest(list_filter(list_transform(regexp_split_to_array(s_name || '、 ' || s_suppkey::varchar || '；；B', '[、;；\\n]+'), lambda x: trim(x)), lambda x: x <> '')) party from supplier")
def split_parties(spark, sf_dir):
    raw = F.concat("s_name", F.lit("、 "), F.col("s_suppkey").cast("string"), F.lit("；；B"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(parties(raw)).alias("party"))


TAG_ROWS = [(1, ["销售误导/夸大收益"]), (2, ["R009", "客户信息不真实", "r005"]), (3, ["合同外利益；赠送利益", "误导"]), (4, ["未知标签"]), (5, []), (6, ["涉及回访违规与电销违规问题"])]
TAG_EXPECTED = [(1, "销售误导,夸大收益", "R001"), (2, "未按规定使用费率条款,客户信息不真实,虚列费用套取资金", "R009,R008,R005"), (3, "合同外利益,赠送利益,销售误导", "R002,R001"), (4, "", ""), (5, "", ""), (6, "回访违规,电销违规", "R007,R001")]


@query(f"select * from {values('id, tags, ids', TAG_EXPECTED)}")
def tag_normalize(spark, sf_dir):
    d = rows(spark, "id int, raw array<string>", TAG_ROWS).withColumn("t", C.normalize_tags(F.col("raw")))
    return d.select("id", F.array_join("t", ",").alias("tags"), F.array_join(C.tags_to_ids(F.col("t")), ",").alias("ids"))


@query("select label % 11 + 1 n, count(*) c, case label % 11 when 0 then '销售误导' when 1 then '合同外利益' when 2 then '虚假宣传' when 3 then '代理人管理不到位' when 4 then '虚列费用套取资金' when 5 then '编制虚假财务资料' when 6 then '回访违规' when 7 then '客户信息不真实' when 8 then '未按规定使用费率条款' when 9 then '培训材料违规' else '其他' end tag from embeddings group by label % 11")
def ids_to_tags(spark, sf_dir):
    n = (F.col("label") % 11 + 1).alias("n")
    d = table(spark, sf_dir, "embeddings").groupBy(n).agg(F.count("*").alias("c"))
    return d.select("n", "c", F.array_join(C.ids_to_tags(F.array(F.format_string("R%03d", "n"))), ",").alias("tag"))


def _span(text: str, tag: str) -> str:
    return "greatest(" + ", ".join(f"length(regexp_extract({text}, '{w}'))" for w in C.KEYWORDS[tag]) + ")"


_SCORES = " union all ".join(
    f"select id, '{t}' tag, {list(C.TAG_IDS).index(t)} pos, {_span('behaviour', t)} span, {min(len(t), 9)} bonus from c" for t in C.KEYWORDS
)


@query(f"""with c as (select id, coalesce(behaviour, '') behaviour from {CASES_REL}), s as ({_SCORES}),
r as (select *, row_number() over (partition by id order by case when span = 1 then 2 else span end * 10 + bonus desc, pos) rk from s where span > 0)
select c.id, coalesce((select array_to_string(list(tag order by rk), ',') from r where r.id = c.id and rk <= 3), '') tags from c""")
def keyword_predict(spark, sf_dir):
    d = rows(spark, "id int, party string, behaviour string, basis string", CASES)
    return d.select("id", F.array_join(C.predict_tags(F.coalesce("behaviour", F.lit(""))), ",").alias("tags"))


@query(f"select * from {values('id, tags', [(1, '虚列费用套取资金,未按规定使用费率条款'), (2, '销售误导'), (3, '欺骗投保人,夸大收益')])}")
def resolve_tags(spark, sf_dir):
    d = rows(spark, "id int, text string, kw array<string>, llm array<string>, cs array<string>", [(1, "", ["虚列费用套取资金"], ["其他"], ["R009"]), (2, "x", [], ["误导", "其他"], []), (3, "欺骗投保人并夸大收益", [], [], [])])
    return d.select("id", F.array_join(C.resolve_tags(F.col("text"), F.col("kw"), F.col("cs"), F.col("llm"), 5), ",").alias("tags"))


_INST = "case " + " ".join(f"when regexp_matches(b, '{p}') then '{t}'" for p, t in C.INSTITUTIONS)


@query(f"""select id, {_INST} when regexp_matches(name, '{C.PERSON}') then '无法判断' else '非保险' end kind
  from (select id, coalesce(party, '') name, coalesce(party, '') || ' ' || coalesce(behaviour, '') b from {CASES_REL})""")
def institution_infer(spark, sf_dir):
    d = rows(spark, "id int, party string, behaviour string, basis string", CASES).na.fill("")
    return d.select("id", C.institution(F.concat("party", F.lit(" "), "behaviour"), F.col("party")).alias("kind"))


@query("""select p_partkey, array_to_string(list_filter(['blue', 'green', 'steel', 'ivory'], lambda t: contains(p_name, t)), ',') terms,
  len(list_filter(['blue', 'green', 'steel', 'ivory'], lambda t: contains(p_name, t))) n from part""")
def term_match(spark, sf_dir):
    """Literal terms of a dictionary in each name of a table."""
    from docketry.functions.text import hits

    found = hits(F.col("p_name"), ["blue", "green", "steel", "ivory"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("terms"), F.size(found).cast("long").alias("n"))


REFINED = [
    (1, ["销售误导"], "以即将停售为由诱导客户投保，实际并未停售", "欺骗投保人,销售误导,诱导投保"),
    (2, ["赠送利益"], "给予投保人保险合同约定以外利益", "合同外利益,赠送利益"),
    (3, ["虚列费用套取资金"], "营业费用核算不真实", "编制虚假财务资料"),
    (4, ["绝对化表述"], "普通文本", ""),
    (5, [], "电话销售中以银行存款名义介绍产品", "销售误导,电销违规"),
    (6, ["委托无资质机构销售"], "委托未取得资格证书的人员从事保险销售", "代理人管理不到位"),
    (7, ["回扣返佣"], None, "合同外利益,回扣返佣"),
]


@query(f"select * from {values('id, tags', [(r[0], r[3]) for r in REFINED])}")
def refine_tags(spark, sf_dir):
    """Tags refined by the text: expected values follow the rules by hand."""
    from docketry.operators.refine import refined

    d = rows(spark, "id int, raw array<string>, text string", [r[:3] for r in REFINED])
    return refined(d, "raw", "text").select("id", F.array_join("refined", ",").alias("tags"))


FILTER_PARTIES = ["平安财产保险公司", "某银行股份公司泰康在线", "张三", "阳光保险经纪"]


def _score_sql(text: str, terms: list[str], other: str | None = None) -> str:
    """SQL for the score of the longest term in a text, or without one in another text."""
    of = lambda t: f"list_max(list_transform(list_filter([{', '.join(repr(x) for x in terms)}], lambda w: contains({t}, w)), lambda w: length(w)))"
    longest = f"coalesce({of(text)}, {of(other)})" if other else of(text)
    return f"(case when {longest} >= 6 then 1.0 when {longest} >= 4 then 0.9 when {longest} >= 3 then 0.75 when {longest} is not null then 0.55 else 0.0 end)::double"


@query(f"""with c as (select doc_id, coalesce([{', '.join(repr(x) for x in FILTER_PARTIES)}][doc_id % 5 + 1], '') party, text || case when doc_id % 3 = 0 then '退保' when doc_id % 3 = 1 then '重疾险与犹豫期' else '' end behaviour,
    case when doc_id % 7 = 0 then '保险法' when doc_id % 7 = 1 then '保险公司管理规定' else '' end basis from documents),
s as (select doc_id, {_score_sql('party', C.ENTITY_TERMS, 'behaviour')} e, {_score_sql("(behaviour || ' ' || party || ' ' || basis)", C.BUSINESS_TERMS)} b,
  {_score_sql('basis', C.REGULATORY_TERMS, 'behaviour')} r, {_score_sql('party', C.EXCLUDE_TERMS)} x from c)
select doc_id, round(e * 0.4 + b * 0.35 + r * 0.25, 6) final, round(e * 0.4 + b * 0.35 + r * 0.25, 6) >= 0.5 and x = 0 is_insurance, e + b + r > 0 and x = 0 is_candidate from s""")
def corpus_filter(spark, sf_dir):
    """The dictionary filter over a whole table: parties, bases and terms of the trade added to its texts."""
    i = F.col("doc_id")
    party = F.try_element_at(F.array(*[F.lit(x) for x in FILTER_PARTIES]), (i % 5 + 1).cast("int"))
    behaviour = F.concat("text", F.when(i % 3 == 0, "退保").when(i % 3 == 1, "重疾险与犹豫期").otherwise(""))
    basis = F.when(i % 7 == 0, "保险法").when(i % 7 == 1, "保险公司管理规定")
    s = C.dictionary_scores(party, behaviour, basis)
    return table(spark, sf_dir, "documents").select("doc_id", *[s[n].alias(n) for n in ("final", "is_insurance", "is_candidate")])


DICTIONARY_TAGS = ["合同外利益", "代理人管理不到位", "编制虚假财务资料", "虚列费用套取资金"]
_TAGS_MAP = "map {" + ", ".join(f"'{t}': '{i}'" for t, i in C.TAG_IDS.items()) + "}"


@query(f"""with e as (select printf('R%03d-01-%02d', item_id % 11 + 1, item_id) id, item_id % 3 + 1 lv, [{', '.join(repr(t) for t in DICTIONARY_TAGS)}][item_id % 4 + 1] tag,
    unnest(list_distinct(regexp_extract_all(text, '[a-z]{{10,}}'))) word from benchmark where item_id % 7 <> 0),
h as (select doc_id, id, tag, row_number() over (partition by doc_id order by lv desc, id) rn from (select distinct doc_id, id, lv, tag from documents join e on contains(text, word))),
f as (select doc_id, tag, min(rn) rn from h group by all),
t as (select doc_id, list(tag order by rn) tags from f group by 1), i as (select doc_id, list(id order by rn) ids from h group by 1),
a as (select doc_id, tags, coalesce(ids[:5], []) ids, doc_id % 5 = 0 k from documents left join t using (doc_id) left join i using (doc_id)),
b as (select doc_id, ids, case when k then list_concat(coalesce(tags, []), ['电销违规']) else coalesce(tags, []) end tags,
  case when k and tags is not null then 'rule+cn_dict' when k then 'cn_dict' else 'rule' end "method" from a),
c as (select doc_id, list(c order by o) cs from (select doc_id, {_TAGS_MAP}[g] c, min(o) o from (select doc_id, unnest(tags) g, unnest(range(len(tags))) o from b) group by all) where c is not null group by 1)
select doc_id, array_to_string(ids, ',') internal_ids, coalesce(array_to_string(cs[:3], ','), '') competition_ids, array_to_string(tags, ',') display_tags, "method" from b left join c using (doc_id)""")
def dictionary_classify(spark, sf_dir):
    """All documents by a dictionary of the long words of the benchmark's items, of three levels, and by key words."""
    from docketry.operators.dictionary import classified

    i = F.col("item_id")
    entries = table(spark, sf_dir, "benchmark").select(
        F.format_string("R%03d-01-%02d", i % 11 + 1, i).alias("risk_type_id"), (i % 3 + 1).cast("int").alias("level"),
        F.array(F.element_at(F.array(*[F.lit(t) for t in DICTIONARY_TAGS]), (i % 4 + 1).cast("int"))).alias("display_tags"),
        F.regexp_extract_all("text", F.lit("[a-z]{10,}"), F.lit(0)).alias("keywords"), (i % 7 != 0).alias("is_active"),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 5 == 0, "电话销售").otherwise("")).alias("text"))
    out = classified(d, "doc_id", "text", entries)
    return out.select("doc_id", "method", *[F.array_join(c, ",").alias(c) for c in ("internal_ids", "competition_ids", "display_tags")])
