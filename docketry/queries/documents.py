"""Pages, decisions and review material."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import extract as X
from docketry.operators import review as V
from docketry.queries.base import query, rows, table, values
from docketry.sources.files import html_text


@query(r"""select page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(
  regexp_replace(html, '(?is)<(script|style|nav|footer)\b.*?</(?:script|style|nav|footer)\s*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) text from pages""")
def html_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(r"""select doc_id, i - 1 pos, sentence from (select doc_id, unnest(s) sentence, generate_subscripts(s, 1) i from (
  select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?]|[^.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') s from documents))""")
def sentence_split(spark, sf_dir):
    parts = F.regexp_extract_all("text", F.lit(r"[^.!?\n]*[.!?]|[^.!?\n]+"), F.lit(0))
    clean = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(clean).alias("pos", "sentence"))


@query()
def segment_sentences(spark, sf_dir):
    """Sentences with offsets into the original text; tests hold the offsets against the text."""
    return V.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


MATERIAL = [
    (1, "营销宣传材料/销售话术审核", "最高收益可达年化4.5%，限时抢购即将停售。"), (2, None, "最高收益可达年化4.5%，限时抢购即将停售。"), (3, None, "投保即送加油卡一张，返佣百分之五。"),
    (4, None, "上述行为违反了《保险法》第一百一十六条的规定。"), (5, None, "本产品由公司正常销售，请仔细阅读条款。"), (6, None, "虚列费用"), (7, None, "该公司虚列业务宣传费用并编制虚假的报表上报。"),
]
_HITS = ", ".join(f"case when regexp_matches(text, '{p}') then '{r}:' || " + ("case when coalesce(scene, '') = '" + V.STRICT_SCENES[0] + "' then 'high' else 'medium' end" if s == "medium" else f"'{s}'") + " end" for p, r, s in V.RULES)


@query(f"""select id, array_to_string(list_filter([{_HITS}], lambda x: x is not null), ',') hits from {values('id, scene, text', MATERIAL)}""")
def risk_rules(spark, sf_dir):
    d = rows(spark, "id int, scene string, text string", MATERIAL)
    h = V.rule_hits(F.col("text"), F.coalesce(F.col("scene").isin(*V.STRICT_SCENES), F.lit(False)))
    return d.select("id", F.array_join(F.transform(h, lambda x: F.concat(x["risk_id"], F.lit(":"), x["severity"])), ",").alias("hits"))


@query(f"select id, regexp_matches(text, '{V.BOILERPLATE}') and not (length(text) > 80 and (" + " or ".join(f"contains(text, '{c}')" for c in V.CUES) + f")) boilerplate from {values('id, scene, text', MATERIAL)}")
def boilerplate(spark, sf_dir):
    return rows(spark, "id int, scene string, text string", MATERIAL).select("id", V.is_boilerplate(F.col("text")).alias("boilerplate"))


@query(r"""with s as (select conv_id, turn, length(text) n, case when regexp_matches(text, '\d{3}') then 3 when contains(text, 'the') then 2 when length(text) > 200 then 1 else 0 end sev from conversations)
select conv_id, count(*) n_turns, count(*) filter (where sev > 0) n_risky, case max(sev) when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'none' end overall_risk from s group by conv_id""")
def overall_risk(spark, sf_dir):
    severity = F.when(F.col("text").rlike(r"\d{3}"), "high").when(F.contains("text", F.lit("the")), "medium").when(F.length("text") > 200, "low")
    c = table(spark, sf_dir, "conversations").withColumn("sev", V.severity_rank(severity))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("sev") > 0).alias("n_risky"), V.overall(F.max("sev")).alias("overall_risk"))


OCR = [
    (1, "当当事事人人：：中中国国人人寿寿保保险险股股份份有有限限公公司司", "当事人：：中国人寿保险股份有限公司"),
    (2, "当 事 人：张三\r\n\r\n\r\n\r\n罚款5万元", "当事人：张三\n\n罚款5万元"),
    (3, "好好学习", "好学习"),
    (4, "plain text\nnext  line\n", "plain text\nnext  line\n"),
    (5, "行行政政处处罚罚详见附件说明内容较长不应整体折叠的正常文字部分谢谢", "行政处罚详见附件说明内容较长不应整体折叠的正常文字部分谢谢"),
    (6, "被处罚当 甲保险公司北京\n名称\n事人单 市宣武支公司\n位", "被处罚当事人 甲保险公司北京市宣武支公司"),
    (7, "1.虚列费用\n2.返佣\n主要违法违规事实：\n罚款", "主要违法违规事实：\n1.虚列费用\n2.返佣\n罚款"),
    (8, "行政处罚决定给予警告\n受处罚当 事人张三", "行政处罚决定 给予警告\n受处罚当事人 张三"),
    (9, None, ""),
    (10, " \n", " \n"),
]


@query(f"select * from {values('id, text', [(r[0], r[2]) for r in OCR])}")
def ocr_normalize(spark, sf_dir):
    return rows(spark, "id int, text string", [r[:2] for r in OCR]).select("id", V.normalize_ocr(F.col("text")).alias("text"))


DECISIONS = [
    (1, "行政处罚决定书\n京银保监罚决字〔2026〕12号\n当事人：中国人寿保险股份有限公司北京分公司\n主要违法违规事实：虚列业务及管理费套取资金用于业务推动。\n依据《保险法》第一百七十条\n行政处罚决定：罚款人民币10万元\n作出处罚决定的机关名称：北京银保监局\n2026年3月3日"),
    (2, "渝保监罚〔2013〕46号 受 处 罚 人 名 称： 重庆某保险代理有限公司；违法行为\n承诺给予投保人保险合同约定以外的利益的事实清楚，依据《保险法》处理\n处罚内容 警告，罚款 3.5 万元\n中国保监会重庆监管局 2013年12月1日"),
    (3, "没有任何字段的文本"),
]
DECISION_FIELDS = [
    (1, "京银保监罚决字〔2026〕12号", "中国人寿保险股份有限公司北京分公司", "10万元", "北京银保监局", "medium", "2026-03-03", "京银保监罚决字〔2026〕12号"[1:]),
    (2, "渝保监罚〔2013〕46号", "重庆某保险代理有限公司", "3.5 万元", "中国保监会重庆监管局", "medium", "2013-12-01", "保监罚〔2013〕46号"),
    (3, None, None, None, None, None, None, None),
]


@query(f"select * from {values('id, doc_no, party, fine, regulator, level, day, doc_key', DECISION_FIELDS)}")
def regex_fields(spark, sf_dir):
    d = rows(spark, "id int, text string", DECISIONS)
    f = X.fields(F.col("text"))
    name, level = X.regulator(F.col("text"), f["penalty_doc_no"])
    return d.select("id", f["penalty_doc_no"].alias("doc_no"), f["party_name"].alias("party"), f["fine_amount"].alias("fine"), name.alias("regulator"), level.alias("level"), X.decision_date(F.col("text")).alias("day"), X.doc_no_key(f["penalty_doc_no"]).alias("doc_key"))


@query("""select p_partkey, round(least(0.98::double, greatest(0.05::double, ((case when p_size > 10 then 1.5 * 0.92::double else 0 end) + (case when p_retailprice > 1000 then 1.5 * 0.72::double else 0 end) + 1.5 * 0.38::double) / 8.3::double
  + case p_partkey % 3 when 0 then -0.03::double when 1 then 0.02::double else 0 end)), 3) confidence from part""")
def confidence_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    filled = lambda c: F.when(c, "x")
    vals = {"party_name": filled(F.col("p_size") > 10), "violation_behavior": filled(F.col("p_retailprice") > 1000), "penalty_content": F.lit("x")}
    levels = {"party_name": F.lit("high"), "violation_behavior": F.lit("medium"), "penalty_content": F.lit("low")}
    method = F.when(F.col("p_partkey") % 3 == 0, "regex").when(F.col("p_partkey") % 3 == 1, "table").otherwise("hybrid")
    return p.select("p_partkey", X.confidence(vals, levels, method).alias("confidence"))


TWO = "X" * 60 + "京银保监罚〔2026〕1号\n当事人：甲保险公司，违法行为：虚列费用若干元并套取资金，予以罚款一万元并警告。再次引用京银保监罚〔2026〕1号。\n当事人：乙保险公司 京银保监罚〔2026〕2号 违法行为：欺骗投保人，夸大收益，编制虚假资料，予以罚款二万元并警告。"


@query()
def segment_cases(spark, sf_dir):
    """Texts cut at their document numbers; tests hold the segments against expected ones."""
    return X.segments(rows(spark, "id int, text string", [(1, TWO), (2, DECISIONS[0][1])]), "id", "text")


CELLS = [
    ("f", 1, 1, ["序号", "当事人名称", "违法违规事实", "处罚决定"]), ("f", 1, 2, ["1", "甲公司", "虚列", "罚款1万元"]), ("f", 2, 1, ["", "", "费用", "并警告"]),
    ("f", 2, 2, ["2", "乙公司", "返佣", "罚款2万元"]), ("g", 1, 1, ["无关", "内容"]),
]


@query(f"select * from {values('file, record, party, behaviour, penalty', [('f', 1, '甲公司', '虚列费用', '罚款1万元并警告'), ('f', 2, '乙公司', '返佣', '罚款2万元')])}")
def table_records(spark, sf_dir):
    r = X.table_records(rows(spark, "file string, page int, row int, cells array<string>", CELLS))
    return r.select("file", F.col("record").cast("int").alias("record"), F.col("party_name").alias("party"), F.col("violation_behavior").alias("behaviour"), F.col("penalty_content").alias("penalty"))


@query(r"""with t as (select doc_id, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') vb, case when doc_id % 3 = 0 then coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')
  when doc_id % 3 = 1 then source else '' end s from (select doc_id, case when doc_id % 7 = 0 then null else text end text, source from documents))
select doc_id, coalesce(substr(nullif(concat_ws(chr(10), case when vb <> '' then '违规行为：' || vb end, case when s <> '' and s <> vb then '案件总结：' || s end), ''), 1, 2000), '保险监管处罚案例') embed_text from t""")
def embed_text(spark, sf_dir):
    """Whole behaviours and summaries, missing and equal ones among them, to 2,000 characters of both."""
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("text"))
    summary = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.embed_text(text, summary).alias("embed_text"))


@query(f"select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) n_tokens, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) n_squeezed from documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"), "[a-z0-9]{2,}")).cast("long").alias("n_tokens"), F.length(F.trim(T.squeeze(F.col("text")))).cast("long").alias("n_squeezed"))


@query("""select conv_id, count(*) n_turns, string_agg(turn || '. ' || text, chr(10) order by turn, role) summary from conversations group by conv_id""")
def material_report(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit(". "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("summary"))


PARTIES = [
    (1, "当事人名称：中国人寿保险股份有限公司", "中国人寿保险股份有限公司", "party_label_prefix_stripped"), (2, "个人", "", "party_placeholder_cleared"),
    (3, "一、甲保险公司 二、张三", "甲保险公司", "party_leading_num_stripped,party_multi_party_truncated"), (4, "某保险公司 住所：北京", "某保险公司", "party_address_tail_stripped"),
    (5, "北京银保监局", "", "party_regulator_as_party_cleared"), (6, "行政处罚决定书（平安财产保险股份有限公司）", "平安财产保险股份有限公司", "party_title"),
    (7, "太平 人寿 保险公司", "太平人寿保险公司", "party_whitespace_collapsed"), (8, "如不服可申请行政复议", "", "party_procedural_cleared"), (9, "甲保险公司）", "甲保险公司", "party_paren_fixed"), (10, None, "", ""),
]


@query(f"select * from {values('id, party, reasons', [(r[0], r[2], r[3]) for r in PARTIES])}")
def clean_parties(spark, sf_dir):
    """Party names cleaned step by step: expected values follow the steps by hand."""
    from docketry.operators.gold import cleaned

    d = cleaned(rows(spark, "id int, party_name string", [r[:2] for r in PARTIES]), "party_name")
    return d.select("id", F.col("party_name").alias("party"), F.array_join("party_name_reasons", ",").alias("reasons"))


OTHER_FIELDS = [
    (1, "文号：京银保监罚决字〔2026〕 12号 被处罚人张三", "处罚机关：国家金融监督管理总局北京监管", "违法行为：虚列 费用", "京银保监罚决字〔2026〕12号", "国家金融监督管理总局北京监管局", "虚列费用"),
    (2, "无号 当事人李四", "向上级申请行政复议", "如不服本决定", "无号", "", ""),
    (3, None, "上海银保监局", None, "", "上海银保监局", ""),
]


@query(f"select * from {values('id, doc_no, regulator, behaviour', [(r[0], *r[4:]) for r in OTHER_FIELDS])}")
def clean_fields(spark, sf_dir):
    from docketry.operators.gold import cleaned

    d = rows(spark, "id int, penalty_doc_no string, regulator string, violation_behavior string", [r[:4] for r in OTHER_FIELDS])
    for c in ("penalty_doc_no", "regulator", "violation_behavior"):
        d = cleaned(d, c)
    return d.select("id", F.trim("penalty_doc_no").alias("doc_no"), "regulator", F.col("violation_behavior").alias("behaviour"))


@query("select reason, count(*) n from (select case when text is null or trim(text) = '' then 'blank' when length(text) > 1000 then 'long' else 'plain' end reason from documents) group by reason")
def clean_reason_counts(spark, sf_dir):
    """Reasons of a cleaner over a whole table, counted."""
    from docketry.operators.gold import clean_report

    text = F.coalesce("text", F.lit(""))
    reason = F.when(F.trim(text) == "", "blank").when(F.length(text) > 1000, "long").otherwise("plain")
    return clean_report(table(spark, sf_dir, "documents").select(F.array(reason).alias("text_reasons")))


MERGES = [(1, "", "low", "京1号", "high", "京1号", True), (2, "模2号", "high", "京2号", "low", "模2号", False), (3, "模3号", "high", "京3号", "high", "京3号", True), (4, "同号", "high", "同号", "medium", "同号", False), (5, "模5号", "high", "", "low", "模5号", False)]


@query(f"select * from {values('id, doc_no, changed', [(r[0], r[5], r[6]) for r in MERGES])}")
def short_field_merge(spark, sf_dir):
    from docketry.operators.gold import merged_fields

    d = rows(spark, "id int, m string, ml string, p string, pl string", [r[:5] for r in MERGES])
    out, changed = merged_fields({"penalty_doc_no": (F.col("m"), F.col("ml"))}, {"penalty_doc_no": (F.col("p"), F.col("pl"))})
    return d.select("id", out["penalty_doc_no"][0].alias("doc_no"), changed.alias("changed"))


@query()
def evidence_snippets(spark, sf_dir):
    from docketry.operators.gold import evidence

    return rows(spark, "id int, text string", DECISIONS).select("id", evidence(F.col("text")).alias("snippet"))


PARTY_TEXTS = [
    (1, "当事人：张三，男\n当事人：中国人寿保险股份有限公司（以下简称公司）", "中国人寿保险股份有限公司", "high"),
    (2, "行政处罚决定书（某某保险经纪有限公司）\n正文", "某某保险经纪有限公司", "medium"),
    (3, "经查，平安财产保险股份有限公司存在下列行为", "平安财产保险股份有限公司", "medium"),
    (4, "受处罚人：李四 职务：经理", "李四", "high"), (5, "没有主体", None, None),
]


@query(f"select * from {values('id, party, level', [(r[0], r[2], r[3]) for r in PARTY_TEXTS])}")
def party_candidates(spark, sf_dir):
    """The best candidate for the party of a text: expected values by hand."""
    name, level = X.party(F.col("text"))
    return rows(spark, "id int, text string", [r[:2] for r in PARTY_TEXTS]).select("id", name.alias("party"), level.alias("level"))
