r"""Column functions for text.  Patterns follow Unicode classes and Unix lines: prefix ``(?Ud)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"
TOKEN = r"[一-鿿]{2,8}|[A-Za-z0-9]{2,}"


def strip(c: Column) -> Column:
    """Without white space at either end, ideographic spaces included."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def from_ideograph(c: Column) -> Column:
    """A text from the character before its first ideograph; empty if it has none.

    A pattern whose matches begin with an ideograph, or with one other character and an ideograph, finds the same in it.
    """
    return F.regexp_extract(c, "(?s).?[一-鿿].*", 0)


def squeeze(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, U + r"\s+", by)


def clip(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis after a cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# The words of a case's text for encoders.
EMBED_BEHAVIOUR, EMBED_SUMMARY, EMBED_NOTHING, EMBED_CHARS = "违规行为：", "案件总结：", "保险监管处罚案例", 2000


def embed_text(behaviour: Column, summary: Column) -> Column:
    """What encoders read of a case: its behaviour and its summary, if that says more."""
    vb, said = (strip(F.coalesce(c, F.lit(""))) for c in (behaviour, summary))
    parts = F.concat_ws("\n", F.when(vb != "", F.concat(F.lit(EMBED_BEHAVIOUR), vb)), F.when((said != "") & (said != vb), F.concat(F.lit(EMBED_SUMMARY), said)))
    return F.when(parts == "", EMBED_NOTHING).otherwise(F.substring(parts, 1, EMBED_CHARS))


def numbered(prefix: str, n: Column) -> Column:
    """Zero-padded id; longer numbers keep all their digits."""
    return F.format_string(prefix + "%06d", n)


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))


def parties(c: Column) -> Column:
    """Parts of a field that names several parties."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[、;；\n]+"), strip)
    return F.filter(parts, lambda p: p != "")


def first_separator_parts(c: Column) -> Column:
    """Split at the first of these separators that occurs at all; blank parts go."""
    separators = ["；", ";", "/", "|", "、", ","]
    out = F.array(c)
    for s in reversed(separators):
        out = F.when(F.contains(c, F.lit(s)), F.split(c, "\\Q" + s + "\\E")).otherwise(out)
    return F.filter(F.transform(out, strip), lambda p: p != "")


def plain_brackets(c: Column) -> Column:
    """Document numbers with one kind of brackets and no blanks."""
    return F.translate(F.regexp_replace(c, U + r"\s+", ""), "[]()", "〔〕（）")


def safe_file_name(c: Column) -> Column:
    """A name that any file system takes, 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\s]+', "_"), r"^[._]+|[._]+$", ""), 1, 80)


# Phrases too general to stand for a tag.
GENERAL_PHRASES = ["隐瞒", "伪造", "变造", "打折", "折扣", "最好", "最优", "第一", "唯一", "年化", "保本", "保息", "存钱", "活期", "回访", "电销", "赠送", "优惠活动", "不当手段", "虚假告知"]


def quoted_phrases(c: Column) -> Column:
    """Up to twelve distinct phrases in quotation marks of 4 to 24 characters that are not general."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[“\"『「]([^”\"』」]{2,24})[”\"』」]"), F.lit(1)), strip)
    return F.slice(F.array_distinct(F.filter(found, lambda p: (F.length(p) >= 4) & (F.length(p) <= 24) & ~p.isin(*GENERAL_PHRASES))), 1, 12)


def redirects(c: Column) -> Column:
    """The tags that a boundary refers cases to."""
    return F.transform(F.regexp_extract_all(c, F.lit("归入([^；;，,、（(]{2,20})"), F.lit(1)), strip)


def loose_date(c: Column) -> Column:
    """The first date in a text as year-month-day: in Chinese signs, else with hyphens, slashes or dots."""
    def found(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
        return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(found(U + r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"), found(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"))


def first_group(c: Column, pattern: str, groups: int = 1) -> Column:
    """First non-empty group of the first match, or null."""
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(c, U + pattern, i)), F.lit("")) for i in range(1, groups + 1)])


def parse_date(c: Column) -> Column:
    """Year-month-day written with hyphens, slashes, dots or the Chinese signs; anything else is null."""
    plain = F.regexp_replace(F.translate(strip(c), "年月/.", "----"), "日$", "")
    ok = plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(ok, F.to_date(F.try_to_timestamp(plain, F.lit("y-M-d"))))


def fine_value(c: Column) -> Column:
    """Numeric value of a fine written as text: digits times 10 000 or 1000 for 万 or 千; blank is 0."""
    number = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.]", "").try_cast("double")
    unit = F.when(c.rlike("万"), 10000.0).when(c.rlike("千"), 1000.0).otherwise(1.0)
    return F.coalesce(number, F.lit(0.0)) * unit


def hits(c: Column, terms: list[str]) -> Column:
    """The terms that occur literally, in the order given."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.coalesce(c, F.lit("")), t))


def any_of(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms])
