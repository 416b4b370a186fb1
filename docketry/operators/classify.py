"""Classification: dictionaries, entities, tags."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import GENERAL_PHRASES, U, any_of, bound, first_separator_parts, from_ideograph, hits, quoted_phrases, strip

# Term dictionaries used where no other is given.
ENTITY_TERMS = (
    "人寿保险 财产保险 健康保险 养老保险 保险股份 相互保险 再保险 保险代理 保险经纪 保险公估 保险销售 人寿 财险 寿险 中国平安 中国太保 中国人保 中国太平 "
    "新华保险 泰康保险 阳光保险 众安在线 泰康在线"
).split()
BUSINESS_TERMS = (
    "承保 退保 保单 保费 理赔 投保人 被保险人 保险合同 保险产品 保险业务 保险条款 银保 个险 团险 中介业务 保险中介 犹豫期 双录 产说会 产品说明会 重疾险 "
    "医疗险 车险 年金险 保全 宽限期 偿付能力 核保 核赔"
).split()
REGULATORY_TERMS = (
    "保险法 保险销售行为管理办法 保险公司管理规定 保险代理人监管规定 保险经纪人监管规定 人身保险 银保监 金融监督管理总局 健康保险管理办法 "
    "保险公司偿付能力管理规定 农业保险条例"
).split()
EXCLUDE_TERMS = "银行股份 农村商业银行 城市商业银行 村镇银行 消费金融 金融租赁 信托有限 小额贷款 融资担保".split()

# Entity types by pattern, with their confidences.
AGENCY = r"保险代理|保险经纪|保险公估|保险销售"
BRANCH = r"分公司|支公司|中心支公司|营业部|营销服务部"
COMPANY = r"保险(股份)?有限公司|相互保险社|再保险"
PERSON = r"^[一-鿿]{2,4}$"

# Tags in their order with the coarse id of each, and the default tag of an id.
TAG_IDS = {
    "欺骗投保人": "R001", "销售误导": "R001", "夸大收益": "R001", "虚假宣传": "R003", "合同外利益": "R002", "赠送利益": "R002", "回扣返佣": "R002",
    "产品说明会违规": "R003", "培训材料违规": "R010", "回访违规": "R007", "电销违规": "R001", "不当比较": "R001", "贬低竞品": "R001", "绝对化表述": "R003",
    "承诺收益": "R001", "保证收益": "R001", "弱化风险提示": "R001", "隐瞒重要信息": "R001", "虚构收益率": "R003", "诱导投保": "R001", "避债避税": "R003",
    "虚列费用套取资金": "R005", "代理人管理不到位": "R004", "委托无资质机构销售": "R004", "未按规定使用费率条款": "R009", "客户信息不真实": "R008",
    "编制虚假财务资料": "R006", "其他": "R011",
}
DEFAULT_TAG = {
    "R001": "销售误导", "R002": "合同外利益", "R003": "虚假宣传", "R004": "代理人管理不到位", "R005": "虚列费用套取资金", "R006": "编制虚假财务资料",
    "R007": "回访违规", "R008": "客户信息不真实", "R009": "未按规定使用费率条款", "R010": "培训材料违规", "R011": "其他",
}
ALIASES = {
    "给予保险合同约定以外利益": ["合同外利益"], "给予投保人保险合同约定以外的其他利益": ["合同外利益"], "给予投保人合同外利益": ["合同外利益"],
    "销售误导/夸大收益": ["销售误导", "夸大收益"], "欺骗投保人/销售误导": ["欺骗投保人", "销售误导"],
    "宣传材料或产品说明会数据资料不真实": ["虚假宣传", "产品说明会违规"], "销售人员执业登记管理不规范": ["代理人管理不到位"],
    "虚构/虚挂中介业务套取费用": ["虚列费用套取资金"], "编制虚假业务资料": ["编制虚假财务资料"], "编制虚假财务数据": ["编制虚假财务资料"],
    "编制提交虚假报表": ["编制虚假财务资料"], "业务财务数据不真实": ["编制虚假财务资料"], "财务数据不真实": ["编制虚假财务资料"],
    "保险代理人侵害消费者权益": ["其他"], "利用开展保险业务牟取不正当利益": ["其他"], "销售违规": ["销售误导"], "消费者权益保护": ["其他"], "误导": ["销售误导"],
    "夸大服务": ["夸大收益", "虚假宣传"], "隐藏重要信息": ["隐瞒重要信息"], "错误解释保险责任": ["销售误导", "欺骗投保人"], "夸大宣传": ["虚假宣传"],
    "引诱投保": ["诱导投保"], "诱导购买": ["诱导投保"], "隐瞒信息": ["隐瞒重要信息"],
}
# Key words of tags, literal or pattern.
KEYWORDS = {
    "合同外利益": [
        "合同约定以外", "合同外利益", "赠送体检卡", "赠送加油卡", "赠送洗车券", "体检卡", "加油卡", "洗车券", "代金券", "油卡", "保费优惠", "首年.*折", "预交.*保费", "预缴.*保费",
    ],
    "赠送利益": ["赠送礼品", "赠送服务", "免费领", "领取礼品", "赠送油卡", "赠送代金券"],
    "回扣返佣": ["返佣", "回扣", "返现", "预缴费打折", "缴费打折", r"\d折"],
    "销售误导": ["销售误导", "误导性", "引人误解", "储蓄计划", "把钱从银行", "利息.*倍", "像存款"],
    "欺骗投保人": ["欺骗投保人", "虚假告知", r"不履行.{0,24}如实告知", "诱导投保人不履行"],
    "夸大收益": ["夸大收益", "最高收益", "稳赚", "年化收益", "翻好几倍", "收益翻倍", "比存银行", r"夸大.{0,8}收益", r"夸大.{0,8}(?:保单|产品|服务)"],
    "承诺收益": ["承诺收益", "保本保息", "保证回报", "一定赚钱", "买了肯定不亏", r"承诺.{0,10}收益", r"承诺(?:给予|保证).{0,10}(?:利益|回报)"],
    "保证收益": ["保证收益", "保证收益率", "稳赚不赔", "保证年化"],
    "弱化风险提示": ["不用担心", "无风险", "零风险", "弱化风险", "完全无风险", "比银行更安全", "免责.*不重要"],
    "隐瞒重要信息": ["未充分告知", "未向投保人说明", "隐瞒与保险合同"],
    "虚构收益率": ["虚构收益", "编造收益", "伪造收益", "虚构分红", "夸大分红", "分红数值", "共同分红率", "错误介绍保险产品收益", r"虚构.{0,8}分红"],
    "绝对化表述": ["行业领先", "全国第一", "独一无二", "行业第一", "排名第一", "市场唯一", "全国唯一", "绝对领先"],
    "虚假宣传": ["虚假宣传", "夸大宣传", "未经.*备案的宣传"],
    "产品说明会违规": ["产品说明会", "产说会"],
    "培训材料违规": ["培训材料", "培训话术", "培训PPT", "培训课件", "培训班", r"培训.{0,10}课件"],
    "电销违规": ["电销", "电话销售"],
    "不当比较": [
        "不当对比", "不当类比", "比存款", "比理财更安全", "片面比较", r"(?:收益|利益|分红).{0,15}(?:存款|银行|证券|理财).{0,10}(?:比较|类比)",
        r"(?:存款|银行).{0,15}(?:比较|类比)",
    ],
    "贬低竞品": ["贬低竞品", "诋毁同业", "同业负面"],
    "诱导投保": ["诱导投保", "限时抢购", "名额有限", "限时限额", "即将停售", "并未停售"],
    "避债避税": ["避债", "避税", "规避债务", "收益免税"],
    "回访违规": ["阻碍.*回访", "阻挠.*回访", "回访过程中", r"回访.{0,6}(?:问题|电话)", r"诱导.{0,10}回访", "回访对象非", "回访记录"],
    "虚列费用套取资金": ["虚列费用", "套取费用", "虚假列支", "虚挂中介"],
    "代理人管理不到位": ["代理人管理", "执业登记", "资格证书", "执业证书", "展业证", "未按规定进行执业", "职业登记管理不规范", "对代理人培训不到位"],
    "委托无资质机构销售": ["委托无资质", "无资质机构", r"委托.{0,20}(?:机构|公司|平台).{0,12}(?:销售|代理)"],
    "未按规定使用费率条款": ["费率条款", "未按规定使用", "擅自变更.*条款"],
    "客户信息不真实": ["客户信息不真实", "回访记录造假"],
}
# Institution types by pattern, in order.
INSTITUTIONS = [
    ("人寿保险|人身保险|健康保险|养老保险|寿险", "寿险公司"), ("财产保险|责任保险|农业保险|农险|财险|产险", "财险公司"), ("保险经纪", "保险经纪"),
    ("保险代理|保险兼业代理|保险销售", "保险代理"), ("保险公估|再保险|相互保险", "其他"), ("保险股份有限公司|保险公司", "保险公司"),
    ("分公司|支公司|营业部|营销服务部|中心支公司", "保险公司"),
]


def hit_score(found: Column) -> Column:
    longest = F.array_max(F.transform(found, F.length))
    return F.when(longest >= 6, 1.0).when(longest >= 4, 0.9).when(longest >= 3, 0.75).when(longest.isNotNull(), 0.55).otherwise(0.0)


def dictionary_scores(party: Column, behaviour: Column, basis: Column) -> dict[str, Column]:
    """entity, business, regulatory and exclude scores, their sum, and the decisions on a case."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    in_party = hits(party, ENTITY_TERMS)
    entity = hit_score(F.when(F.size(in_party) > 0, in_party).otherwise(hits(behaviour, ENTITY_TERMS)))
    business = hit_score(hits(F.concat(blank(behaviour), F.lit(" "), blank(party), F.lit(" "), blank(basis)), BUSINESS_TERMS))
    in_basis = hits(basis, REGULATORY_TERMS)
    regulatory = hit_score(F.when(F.size(in_basis) > 0, in_basis).otherwise(hits(behaviour, REGULATORY_TERMS)))
    exclude = hit_score(hits(party, EXCLUDE_TERMS))
    final = F.round(entity * 0.4 + business * 0.35 + regulatory * 0.25, 6)
    return {
        "entity": entity, "business": business, "regulatory": regulatory, "excluded": exclude, "final": final,
        "is_insurance": (final >= 0.5) & (exclude == 0), "is_candidate": (entity + business + regulatory > 0) & (exclude == 0),
    }


def entity_type(name: Column) -> Column:
    branch = name.rlike(BRANCH) & name.rlike(COMPANY)
    return F.when(name.rlike(AGENCY), "保险代理中介").when(branch, "保险分支机构").when(name.rlike(COMPANY), "保险公司").when(name.rlike(PERSON), "责任人员").otherwise("第三方主体")


def entity_confidence(name: Column) -> Column:
    kind = entity_type(name)
    return F.when(kind == "责任人员", 0.7).when(kind == "第三方主体", 0.5).otherwise(0.9)


def normalized_name(name: Column) -> Column:
    short = F.regexp_replace(name, U + r"[\s（(].*?[）)]?$", "")
    return F.when(short == "", name).otherwise(short)


def _map(d: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for k, v in d.items() for x in (k, F.array(*map(F.lit, v)) if isinstance(v, list) else v)])


def expand_tag(tag: Column) -> Column:
    """Canonical tags of one label: itself, the default of an id, an alias, canonical names in it, an alias in it or of it."""
    names = F.array(*[F.lit(t) for t in TAG_IDS])
    aliases = F.array(*[F.lit(a) for a in ALIASES])
    inside = F.filter(names, lambda t: F.contains(tag, t))
    near = F.filter(aliases, lambda a: F.contains(tag, a) | F.contains(a, tag))
    alias_of = lambda a: F.try_element_at(_map(ALIASES), a)
    return (
        F.when(F.array_contains(names, tag), F.array(tag))
        .when(F.try_element_at(_map(DEFAULT_TAG), F.upper(tag)).isNotNull(), F.array(F.try_element_at(_map(DEFAULT_TAG), F.upper(tag))))
        .when(alias_of(tag).isNotNull(), alias_of(tag))
        .when(F.size(inside) > 0, inside)
        .when(F.size(near) > 0, alias_of(F.try_element_at(near, F.lit(1))))
        .otherwise(F.array().cast("array<string>"))
    )


def normalize_tags(tags: Column) -> Column:
    """Ordered distinct canonical tags of an array of labels, each of which may hold several."""
    parts = F.flatten(F.transform(tags, lambda t: F.when(_is_alias(t), F.array(strip(t))).otherwise(first_separator_parts(strip(t)))))
    return F.array_distinct(F.flatten(F.transform(parts, expand_tag)))


def _is_alias(t: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(a) for a in (*ALIASES, *TAG_IDS)]), strip(t))


def tags_to_ids(tags: Column) -> Column:
    ids = F.transform(tags, lambda t: F.try_element_at(_map(TAG_IDS), t))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def ids_to_tags(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.try_element_at(_map(DEFAULT_TAG), x)), lambda x: x.isNotNull()))


def predict_tags(text: Column, limit: int = 3) -> Column:
    """Tags by key words: the longest match counts ten times, the tag's name breaks ties.

    All key words hold ideographs: what stands before the first one is not searched.
    """
    none = F.array().cast("array<string>")
    return bound(from_ideograph(text), lambda t: F.when(F.coalesce(t, F.lit("")) == "", none).otherwise(_predicted(t, limit)))


def _predicted(text: Column, limit: int) -> Column:
    def span(word: str) -> Column:
        if re.escape(word) == word:
            return F.when(F.contains(text, F.lit(word)), len(word)).otherwise(0)
        return F.length(F.regexp_extract(text, U + word, 0))

    # Every text is searched once for a word; what follows reads the lengths.
    longest = F.array(*[F.greatest(*map(span, words)) if len(words) > 1 else span(words[0]) for words in KEYWORDS.values()])
    each = F.array(*[F.struct(F.lit(min(len(t), 9)).alias("bonus"), F.lit(list(TAG_IDS).index(t)).alias("pos"), F.lit(t).alias("tag")) for t in KEYWORDS])
    scored = F.zip_with(longest, each, lambda n, e: F.struct((-(F.when(n == 1, 2).otherwise(n) * 10 + e["bonus"])).alias("neg"), e["pos"].alias("pos"), e["tag"].alias("tag"), (n > 0).alias("hit")))
    found = F.array_sort(F.filter(scored, lambda x: x["hit"]))
    return F.slice(F.transform(found, lambda x: x["tag"]), 1, limit)


def apply_exclusions(text: Column, tags: Column, redirects: list[tuple[str, str, list[str]]]) -> Column:
    """Tags whose boundary refers a text to another tag give way to it.

    ``redirects``: (tag, target, triggers), a small reference table.  A boundary holds if it names no trigger or one of
    them occurs; the tag then goes if the target is among the tags or the boundary names triggers, and the target joins.
    """
    def holds(tag: str, target: str, triggers: list[str]) -> Column:
        said = any_of(text, triggers) if triggers else F.array_contains(tags, target)
        return F.array_contains(tags, tag) & said

    none = F.lit(None).cast("string")
    gone = F.filter(F.array(*[F.when(holds(*r), F.lit(r[0])) for r in redirects], none), lambda x: x.isNotNull())
    come = F.filter(F.array(*[F.when(holds(*r), F.lit(r[1])) for r in redirects], none), lambda x: x.isNotNull())
    # Targets join in the order of the tags that they stand for.
    order = [F.filter(come, lambda x: x.isin(*[r[1] for r in redirects if r[0] == t] or [""])) for t in TAG_IDS]
    come = F.filter(F.array_distinct(F.concat(*order)) if redirects else come, lambda x: ~F.array_contains(tags, x))
    kept = F.filter(tags, lambda t: ~F.array_contains(gone, t))
    return F.when(F.size(tags) <= 1, tags).otherwise(F.concat(kept, come))


def resolve_tags(
    text: Column, keyword: Column, case_tags: Column, model: Column, limit: int, ids: Column | None = None, redirects: list[tuple[str, str, list[str]]] | None = None
) -> Column:
    """Ordered union of tag sources; without any, by key words, then by ids; boundaries; 其他 only if it is alone."""
    merged = normalize_tags(F.concat(keyword, model, case_tags))
    merged = F.when(F.size(merged) > 0, merged).otherwise(predict_tags(text))
    if ids is not None:
        merged = F.when(F.size(merged) > 0, merged).otherwise(ids_to_tags(ids))
    if redirects:
        merged = apply_exclusions(text, merged, redirects)
    others = F.array_remove(merged, "其他")
    return F.slice(F.when(F.size(others) > 0, others).otherwise(merged), 1, limit)


def institution(text: Column, name: Column) -> Column:
    out = F.when(entity_type(name) == "责任人员", "无法判断").otherwise("非保险")
    return reduce(lambda rest, rule: F.when(text.rlike(rule[0]), rule[1]).otherwise(rest), reversed(INSTITUTIONS), out)


# Names of the flat ids of a submission, and older names of institution types.
SUBMISSION_NAMES = {
    "R001": "欺骗投保人/销售误导", "R002": "给予保险合同约定以外利益", "R003": "宣传材料或产品说明会数据资料不真实", "R004": "销售人员执业登记管理不规范",
    "R005": "虚构/虚挂中介业务套取费用", "R006": "编制虚假财务资料", "R007": "保险代理人侵害消费者权益", "R008": "利用开展保险业务牟取不正当利益",
}
INSTITUTION_ALIASES = {"保险代理/中介": "保险代理", "保险分支机构": "保险公司", "保险代理人": "其他", "其他金融机构": "其他"}
INSTITUTION_TYPES = ["保险公司", "寿险公司", "财险公司", "保险代理", "保险经纪", "其他", "非保险", "无法判断"]


def flat_id(internal: Column) -> Column:
    """The flat id that an internal one of three levels stands under; empty if a submission has no such id."""
    root = F.split(internal, "-")[0]
    return F.when(root.isin(*SUBMISSION_NAMES), root).otherwise("")


def submission_types(internal: Column) -> Column:
    """Names of the flat ids of an array of internal ones, each once, in the order of the ids."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(internal, flat_id), lambda x: x != "")))
    return F.array_join(F.transform(ids, lambda x: F.element_at(_map(SUBMISSION_NAMES), x)), "；")


def coerced_institution(raw: Column) -> Column:
    """A type of today for any older or foreign name; unknown and missing ones are 非保险."""
    name = strip(F.coalesce(raw, F.lit("")))
    name = F.coalesce(F.try_element_at(_map(INSTITUTION_ALIASES), name), name)
    return F.when(name.isin(*INSTITUTION_TYPES), name).otherwise("非保险")


def merged_keywords(keywords: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tag, keyword): key words (tag, keyword) and the quoted phrases of a catalog (tag, typical), each once; 其他 has none."""
    phrases = catalog.select("tag", F.explode(quoted_phrases(F.col("typical"))).alias("keyword")).where(~F.col("keyword").isin(*GENERAL_PHRASES))
    return keywords.select("tag", "keyword").unionByName(phrases).where("tag <> '其他'").distinct()
