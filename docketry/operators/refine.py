"""Refinement of tags by the text they were given for: a table of rules over regex flags, applied in order.

A rule is (condition, actions).  Conditions are functions of ``f`` (the flags of the text) and ``has`` (tags present
so far); actions drop a tag, put it first or last.  Flags are computed once; each rule is one column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import U, bound, from_ideograph
from docketry.operators.classify import normalize_tags

# What the flags look for.
FLAGS = {
    "text": r"[\s\S]",
    "fake_gift": r"虚假宣传赠送|宣传赠送.{0,24}并未|实际并未赠送|并未赠送",
    "real_extra": r"合同约定以外|合同外利益|回扣|返佣|赠送油卡|赠送体检|赠送礼品|赠送洗车",
    "staff_extra": r"给予.{0,16}(?:工作人员|员工|营销员|代理人|保险机构).{0,24}(?:合同外|约定以外|额外).{0,8}利益|(?:工作人员|员工).{0,12}合同约定以外",
    "customer": r"投保人|被保险人|客户",
    "ratio_return": r"按比例返还保费|比例返还保费|承诺.{0,8}返还保费",
    "telesales": r"电销|电话销售|电话营销|电话业务销售|销售录音",
    "bank": r"销售误导|错误解释保险责任|银行存款|储蓄计划|以银行.{0,8}名义|存款赠送|存款送保险|以存款|像存款|存钱送|把保险当存款|换个地方存钱|换种方式存储|"
    r"换个方式存储|银行理财名义|以理财名义|混淆.{0,8}存款|以(?:银行存款|银行理财|储蓄|理财).{0,12}(?:名义|形式).{0,20}(?:宣传|销售|介绍)|"
    r"(?:购买保险|买保险|投保).{0,12}(?:宣传为|说成|称为).{0,8}(?:存钱|存款|储蓄)|片面.{0,12}(?:解释|介绍|说明).{0,12}(?:条款|责任)",
    "stop_sale": r"即将停售|实际并未停售|从未停售|并未停售|以即将停售为由|停售等情况作虚假宣传|对保险产品价格、停售|以产品升级名义诱导",
    "induce": r"限时抢购|名额有限|限时限额|即将停售|并未停售|停售等情况作虚假宣传|以产品升级名义诱导",
    "not_disclose": r"诱导投保人不履行|不履行.{0,20}如实告知",
    "meeting": r"产品说明会|产说会",
    "meeting_wrong": r"管理不到位|违规|误导|虚假|未经备案|未按规定",
    "loose_management": r"管理不到位",
    "clear_mislead": r"销售误导行为|错误解释|银行存款|储蓄计划|片面",
    "training": r"培训(?:材料|课件|PPT|话术)|营销员培训|个险营销员培训|培训用.{0,8}课件",
    "training_wrong": r"虚假宣传|误导|绝对化|不实",
    "public_media": r"宣传单|海报|公众号|短视频|对外宣传|广告|自印",
    "flyer": r"自印宣传单|自印.{0,6}宣传单",
    "unlicensed": r"(?:未取得|没有|无).{0,8}(?:资格证|执业证|展业证|资格证书|执业证书)|无资格证|无执业证|无展业证|未按规定进行执业|执业登记|执业证书人员|"
    r"无资格证书.{0,8}人员|人员从事保险销售",
    "unlicensed_firm": r"委托.{0,40}(?:无资质|不具备资质|未取得.{0,16}资质).{0,24}(?:机构|公司|平台).{0,20}(?:销售|代理)|与无资质的第三方|代理机构业务台账|台账要素不齐",
    "staff": r"人员|营销员|从业人员|个人代理人",
    "certificate": r"资格证|执业证|展业证",
    "wealth": r"投资理财",
    "guarantee": r"保证年化|保证收益率|保证收益\d|保证.{0,8}\d+(?:\.\d+)?\s*%|固定利息\s*\d|固定利息.{0,12}%|复利分红\s*\d|日复利滚息|分红\s*\d+\s*万|回报金额|保证回报|"
    r"(?:年化|收益|分红|利息).{0,6}\d+(?:\.\d+)?\s*%.{0,8}保证|保证.{0,12}(?:年化|收益|分红|利息).{0,8}\d",
    "exaggerated": r"夸大收益|夸张|推测",
    "false_cost": r"虚列|虚构.{0,16}(?:费用|业务)|虚假列支|虚挂中介",
    "misuse": r"套取(?:费用|资金)|贴补手续费|(?:用于|转入|支付|发放|拨付).{0,24}(?:手续费|奖励|返佣|补贴|福利|展业)|假发票|虚假报销|虚假赔案|与列支名目不符",
    "false_report": r"营业费用核算不真实|费用列支不规范|会计记录不实|业务财务数据不真实|编制提交虚假报表|编制虚假报表|编制虚假财务资料|财务数据不真实|业务资料不真实",
    "absolute": r"行业第一|排名第一|市场唯一|独一无二|全国第一|行业领先|全国唯一|绝对领先",
    "fictive": r"虚构.{0,8}(?:分红|收益)|夸大分红|编造收益|伪造收益|虚构收益率|错误介绍.{0,12}收益|分红数值|共同分红率",
    "weaken": r"不用担心|零风险|无风险|完全无风险|忽略免责|免责.{0,8}不重要|一定赔",
    "client": r"客户信息不真实|客户行为不真实|代签|代为签名|代投保人签名|代替投保人|客户签名代签|代抄风险提示|笔迹与签名不一致|代为抄写|抄录风险提示|抄录笔迹|"
    r"客户(?:电话|地址|联系方式).{0,8}不真实|投保人.{0,12}信息不真实|被保险人.{0,12}信息不真实|被保险人信息资料不真实|没有被保险人.{0,8}信息|"
    r"无被保险人.{0,8}信息|信息记录虚假|客户信息.{0,8}虚假|客户信息资料不真实|回访记录造假|回访对象非|回访均不成功|变更客户信息|更改.{0,12}电话号码|"
    r"联系方式变更为|虚构投保农户|虚假客户",
    "archive": r"(?:代理人|营销员|从业人员|入职|执业).{0,24}(?:档案|材料|资料).{0,24}代签|代签.{0,24}(?:代理人|营销员).{0,16}(?:档案|材料|资料)|入职档案.{0,16}代签|"
    r"档案材料.{0,12}代签",
    "client_context": r"投保人|被保险人|客户签名|回访|客户电话|客户地址",
    "other_hint": r"任职资格|未取得.{0,16}核准|牟取不正当利益|保险资金委托|投资理财|问题档案|自查报告|内控制度.{0,8}不到位|拒绝.{0,8}监督检查|妨碍监督检查|"
    r"唆使.{0,12}代理人.{0,16}诚信|隐瞒事实",
    "deceive": r"欺骗投保人|欺骗被保险人|欺骗受益人|私印保单|隐瞒投保人|不履行.{0,30}如实告知|诱导投保人不履行",
}


def _rules(f, has, size):
    """The table: each entry is computed from the tags that the entries before it left."""
    stop = lambda: f("stop_sale") | f("induce")
    real_misuse = lambda: f("false_cost") & f("misuse")
    archive_only = lambda: f("archive") & ~f("client_context")
    yield lambda: f("fake_gift"), ["-赠送利益"]
    yield lambda: f("fake_gift") & ~f("real_extra"), ["-合同外利益"]
    yield lambda: f("fake_gift"), ["^欺骗投保人"]
    yield lambda: f("staff_extra") & ~f("customer"), ["-合同外利益"]
    yield lambda: has("赠送利益") | has("回扣返佣"), ["^合同外利益"]
    yield lambda: f("ratio_return"), ["-合同外利益"]
    yield lambda: f("telesales"), ["-虚假宣传"]
    yield lambda: f("telesales") & f("bank"), ["+销售误导"]
    yield lambda: f("telesales"), ["+电销违规"]
    yield lambda: f("telesales") & stop() & ~f("bank"), ["-销售误导"]
    yield lambda: f("bank"), ["+销售误导"]
    yield lambda: f("not_disclose"), ["^欺骗投保人"]
    yield lambda: f("not_disclose") & ~stop(), ["-诱导投保"]
    yield lambda: stop(), ["+诱导投保"]
    yield lambda: f("stop_sale"), ["^欺骗投保人"]
    yield lambda: f("meeting") & f("meeting_wrong"), ["+产品说明会违规"]
    yield lambda: f("meeting") & f("loose_management") & ~f("clear_mislead"), ["-销售误导"]
    yield lambda: f("training") & f("training_wrong"), ["+培训材料违规"]
    yield lambda: f("training") & ~f("public_media"), ["-虚假宣传"]
    yield lambda: f("flyer") & ~f("training"), ["+虚假宣传"]
    licence = lambda: f("unlicensed") | (f("staff") & f("certificate"))
    yield lambda: licence(), ["+代理人管理不到位"]
    yield lambda: licence() & ~f("unlicensed_firm"), ["-委托无资质机构销售"]
    yield lambda: has("委托无资质机构销售") & f("wealth") & ~f("unlicensed_firm"), ["-委托无资质机构销售", "+其他"]
    yield lambda: f("guarantee") & ~has("保证收益") & ~f("exaggerated"), ["-夸大收益"]
    yield lambda: f("guarantee"), ["+保证收益"]
    siphon = lambda: (f("false_report") & ~real_misuse()) | (f("false_cost") & ~f("misuse"))
    yield lambda: has("虚列费用套取资金") & siphon(), ["-虚列费用套取资金", "+编制虚假财务资料"]
    yield lambda: f("false_report") & ~real_misuse(), ["+编制虚假财务资料"]
    yield lambda: f("absolute"), ["+绝对化表述"]
    yield lambda: f("text") & ~f("absolute"), ["-绝对化表述"]
    yield lambda: f("fictive"), ["+虚构收益率"]
    yield lambda: f("text") & ~f("fictive"), ["-虚构收益率"]
    yield lambda: f("text") & ~f("weaken"), ["-弱化风险提示"]
    yield lambda: has("客户信息不真实") & archive_only(), ["-客户信息不真实"]
    yield lambda: f("client") & ~f("archive"), ["+客户信息不真实"]
    yield lambda: has("客户信息不真实") & f("text") & ~f("client") & f("other_hint") & (size() <= 2), ["-客户信息不真实", "+其他"]
    yield lambda: f("text") & ~f("client"), ["-客户信息不真实"]
    yield lambda: f("deceive") | has("绝对化表述") | has("虚构收益率"), ["^欺骗投保人"]
    spared = lambda: f("deceive") | f("absolute") | f("fictive") | f("stop_sale") | f("fake_gift")
    yield lambda: f("bank") & ~spared(), ["-欺骗投保人"]


def _applied(tags: Column, action: str) -> Column:
    tag = F.lit(action[1:])
    if action[0] == "-":
        return F.array_remove(tags, tag)
    absent = ~F.array_contains(tags, tag)
    return F.when(absent, F.array_prepend(tags, tag) if action[0] == "^" else F.array_append(tags, tag)).otherwise(tags)


def refined(df: DataFrame, tags: str, text: str, out: str = "refined") -> DataFrame:
    """``df`` with the refined tags; all flags are one struct column, each rule one further step."""
    blob = F.coalesce(F.col(text), F.lit(""))
    # Bound as a whole: Spark would put the searches in place of each use of a flag.
    flags = bound(from_ideograph(blob), lambda t: F.struct(*[((blob != "") if n == "text" else (t != "") & t.rlike(U + p)).alias(n) for n, p in FLAGS.items()]))
    df = df.withColumn("_flags", flags).withColumn("_tags", normalize_tags(F.col(tags)))
    f = lambda name: F.col("_flags")[name]
    has = lambda tag: F.array_contains("_tags", tag)
    for condition, actions in _rules(f, has, lambda: F.size("_tags")):
        changed = F.col("_tags")
        for action in actions:
            changed = _applied(changed, action)
        df = df.withColumn("_tags", F.when(condition(), changed).otherwise(F.col("_tags")))
    return df.withColumn(out, normalize_tags(F.col("_tags"))).drop("_flags", "_tags")
