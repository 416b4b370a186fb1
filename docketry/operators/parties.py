r"""Parties of decision texts: candidates, repair across line breaks, lists of parties that models answer with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import U, any_of, bound, strip
from docketry.operators.extract import PARTY_ALT, PARTY_HEADER, PATTERNS, spaced

# Signs of institutions, names that are labels, what ends a name, places of a name in a title.
INSTITUTION = "公司|保险|人寿|财险|产险|经纪|代理|公估|营业部|服务部|电销中心"
NO_NAME = ["个人姓名", "单位名称", "名称", "姓名", "当事人", "主要负责人", "法定代表人", "负责人姓名", "营业地址", "住所"]
NAME_STOPS = r"告知了|作出行政|行政处罚|强制执行|划款凭证|抄报我局|营业地址|住\s*所|地址|身份证号|职务"
PARTY_TITLE = r"(?s)\A.{0,400}?(?<![机关单位部处科])" + spaced("名称") + r"[：:\s]+([^\n。；;，,]{4,80})"
# What ends the rest of a name on the next line, and how such a rest ends.
REST_STOPS = ["当事人", "住所", "地址", "身份证", "职务：", "统一社会信用代码", "案由", "主要违法", "违法事实", "违法行为", "\n", "：", ":"]
REST_ENDS = r"(?:公司|营业部|服务部|电销中心)\z"
#: Characters of the next line that are looked at.
REST_CHARS = 60
WORD = "[一-鿿A-Za-z0-9"


def is_institution(name: Column) -> Column:
    return name.rlike(INSTITUTION)


def candidate(raw: Column) -> Column:
    """A captured name without label, address and office; a short form in brackets stays with it."""
    def shortened(n: Column) -> Column:
        first, rest = F.regexp_extract(n, r"^([^，,]*)[，,]", 1), F.regexp_extract(n, r"[，,]([\s\S]*)$", 1)
        return F.when(n.rlike("[，,]") & is_institution(first) & ~is_institution(rest), strip(first)).otherwise(n)

    def ended(n: Column) -> Column:
        short = F.regexp_extract(n, r"^(.+?[（(]以下简称[^）)]*[）)])", 1)
        opened = F.regexp_extract(n, r"^(.+?[（(]以下简称)", 1)
        cut = F.regexp_replace(F.split(n, U + NAME_STOPS, 2)[0], "^[ ，,、]+|[ ，,、]+$", "")
        return F.when(short != "", short).when(opened != "", opened).otherwise(cut)

    def balanced(n: Column) -> Column:
        more = F.regexp_count(n, F.lit("[）)]")) > F.regexp_count(n, F.lit("[（(]"))
        return F.substring(strip(F.when(more, F.regexp_replace(n, U + r"[）)]\s*$", "")).otherwise(n)), 1, 80)

    bare = F.regexp_replace(F.regexp_replace(raw, r"^[ ：:\t　]+|[ ：:\t　]+$", ""), U + r"^(?:名称|姓名)\s*[：:]\s*", "")
    return bound(bound(bound(bare, shortened), ended), balanced)


def is_no_name(name: Column) -> Column:
    return name.isin(*NO_NAME) | name.rlike(r"^(?:个人|单位|机构)?(?:姓名|名称)\z")


def repaired(name: Column, text: Column) -> Column:
    """A name that its text goes on with on the next line, put together again.

    The rest is what stands behind the first occurrence of the name and one line break, up to a stop word.  It joins if
    it closes a bracket that the name leaves open, or else if it ends like a firm; otherwise the name stays.  A null name
    is null, an empty one empty.
    """
    def placed(n: Column) -> Column:
        end = F.instr(text, n) + F.length(n)
        behind = F.substr(text, end + 1, F.lit(REST_CHARS))
        broken = (n != "") & (F.instr(text, n) > 0) & (F.substr(text, end, F.lit(1)) == "\n")
        rest = F.regexp_extract(behind, r"^([\s\S]*?)(?:" + "|".join(REST_STOPS) + r"|\z)", 1)
        return F.struct(n.alias("name"), F.when(broken, rest).otherwise("").alias("rest"))

    def joined(x: Column) -> Column:
        n, rest = x["name"], x["rest"]
        is_open = F.regexp_count(n, F.lit("[（(]")) > F.regexp_count(n, F.lit("[）)]"))
        closing = F.regexp_extract(rest, "^(" + WORD + "]{1,50}?[）)])", 1)
        plain = rest.rlike("^" + WORD + r"（）()]{1,50}\z")
        return F.when(plain & is_open, F.concat(n, closing)).when(plain & rest.rlike(REST_ENDS), F.concat(n, rest)).otherwise(n)

    return bound(bound(name, placed), joined)


def best(text: Column, labelled: bool = True) -> Column:
    """The best candidate for the party of a text as a struct (name, level); null without any.

    All labelled mentions (high; institutions first, persons last) and the first mention in a title, behind 经查 or in the
    heading (medium; institutions as good as labelled ones).  Of equal ones the longer institution, then the earlier, wins.
    """
    def found(captured: Column, level: str, firm: int, person: int) -> Column:
        names = F.transform(F.transform(captured, candidate), lambda n: repaired(n, text))
        return F.transform(
            F.filter(names, lambda n: (n != "") & ~is_no_name(n)),
            lambda n, i: F.struct(
                F.when(is_institution(n), firm).otherwise(person).alias("p"), F.when(is_institution(n), F.length(n)).otherwise(0).alias("n"),
                n.alias("name"), F.lit(level).alias("level"), i.alias("i"),
            ),
        )

    def first(pattern: str, signs: list[str]) -> Column:
        return F.filter(F.array(F.when(any_of(text, signs), F.regexp_extract(text, U + pattern, 1)).otherwise("")), lambda x: x != "")

    places = [(PARTY_TITLE, ["名"]), (PARTY_ALT, ["经查", "对"]), (PARTY_HEADER, ["决定书", "公开表", "处罚信息"])]
    lists = [found(first(*p), "medium", 3, 2) for p in places]
    if labelled:
        lists.insert(0, found(F.regexp_extract_all(text, F.lit(U + PATTERNS["party_name"][0]), F.lit(1)), "high", 3, 1))
    ranked = F.transform(F.concat(*lists), lambda x, at: F.struct(x["p"], x["n"], (-at).alias("at"), x["name"].alias("name"), x["level"].alias("level")))
    return F.array_max(ranked)


def party_names(value: Column) -> Column:
    """Names of a model's party field: a JSON list of them, or one string; blank and null names are none."""
    text = strip(F.coalesce(value, F.lit("")))
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    names = F.transform(F.coalesce(listed, F.array(text)), lambda n: strip(F.coalesce(n, F.lit(""))))
    return F.filter(names, lambda n: (n != "") & (F.lower(n) != "null"))


def one_party_each(items: DataFrame, column: str = "party_name") -> DataFrame:
    """``items`` with one row for each party of a field that lists several; other columns are repeated.

    A field without any name keeps its row, with an empty name.
    """
    return items.withColumn(column, F.explode_outer(party_names(F.col(column)))).withColumn(column, F.coalesce(column, F.lit("")))
