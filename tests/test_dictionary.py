"""Classification by a table of key words."""

import random

from docketry.operators import dictionary


def test_words_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc甲乙") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None]
    words = ["".join(rng.choice("abc甲乙") for _ in range(rng.randrange(1, 6))) for _ in range(150)] + ["", None, "a"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    true = sorted({(i, x) for i, t in enumerate(texts) for x in words if t and x and x in t})
    assert sorted((r.id, r.word) for r in dictionary.word_hits(d, "id", "text", w).collect()) == true
    # A dictionary beyond the bound goes over the texts in parts and finds the same.
    monkeypatch.setattr(dictionary, "AUTOMATON_CHARS", 100)
    assert sorted((r.id, r.word) for r in dictionary.word_hits(d, "id", "text", w).collect()) == true
    assert dictionary.word_hits(d, "id", "text", w.limit(0)).count() == 0


def test_levels_methods_and_models(spark):
    entries = [
        ("R001-01", 1, ["销售误导"], ["误导"], True), ("R002-01-01", 3, ["合同外利益"], ["油卡", "礼品"], True), ("R002-01", 3, ["赠送利益"], ["油卡"], True),
        ("R006", 2, ["编制虚假财务资料"], ["误导"], False), ("R005", None, None, ["空"], True),
    ]
    e = spark.createDataFrame(entries, "risk_type_id string, level int, display_tags array<string>, keywords array<string>, is_active boolean")
    texts = [(1, "误导客户并送油卡"), (2, "送礼品，免费领"), (3, "赠送礼品"), (4, "无关"), (5, None), (6, "空"), (7, "误导")]
    d = spark.createDataFrame(texts, "id int, text string")
    by = {r.id: r for r in dictionary.matched_entries(d, "id", "text", e).collect()}
    assert by[1].internal_ids == ["R002-01", "R002-01-01", "R001-01"] and by[1].display_tags == ["赠送利益", "合同外利益", "销售误导"] and 4 not in by
    answers = spark.createDataFrame([(7, ["电销违规", "未知"]), (4, []), (5, ["销售误导"])], "id int, tags array<string>")
    out = {r.id: r for r in dictionary.classified(d, "id", "text", e, answers).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7]
    assert out[7].method == "llm_cn" and out[7].internal_ids == [] and "电销违规" in out[7].display_tags
    assert out[4].method == "rule" and out[5].method == "rule" and out[5].internal_ids == []
    assert out[6].internal_ids == ["R005"] and out[6].competition_ids[:1] == ["R005"]
    assert out[2].method == "rule+cn_dict" and out[3].method.endswith("cn_dict")


def _beginnings(parsed, spent=0):
    """Positions (0 or 1) at which the first ideograph of a match may stand, or None where something else may stand there."""
    from re import _constants as c

    for i, (op, arg) in enumerate(parsed):
        if op is c.LITERAL and "一" <= chr(arg) <= "\u9fff":
            return {spent}
        if op is c.SUBPATTERN:
            return _beginnings([*arg[3], *parsed[i + 1 :]], spent)
        if op is c.BRANCH:
            return set().union(*(_beginnings([*b, *parsed[i + 1 :]], spent) for b in arg[1]))
        if op is c.IN and spent == 0 and all(o in (c.LITERAL, c.CATEGORY, c.RANGE) for o, _ in arg):
            ideographs = all(o is c.LITERAL and "一" <= chr(v) <= "\u9fff" for o, v in arg)
            return {0} if ideographs else _beginnings(parsed[i + 1 :], 1)
        return {None}
    return {None}


def test_text_before_the_first_ideograph_is_not_searched(spark):
    """All key words and flags begin with an ideograph or stand one character before it, so that the rest decides nothing."""
    from re import _parser

    from pyspark.sql import functions as F

    from docketry.functions.text import from_ideograph
    from docketry.operators import classify, refine

    patterns = [p for n, p in refine.FLAGS.items() if n != "text"] + [w for words in classify.KEYWORDS.values() for w in words]
    for p in patterns:
        assert _beginnings(list(_parser.parse(p))) <= {0, 1}, p
    rows = [("latin " * 50, ""), ("a\n8折 b", "8折 b"), ("电话销售", "电话销售"), ("\n电\nx", "\n电\nx"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [tuple(r) for r in df.select(from_ideograph(F.col("t")), "want").collect()] == [(w, w) for _, w in rows]
    said = [r[0] for r in df.select(classify.predict_tags(F.col("t"))).collect()]
    assert said == [[], ["回扣返佣"], ["电销违规"], [], [], []]
    tags = df.withColumn("tags", F.array(F.lit("绝对化表述"))).withColumn("n", F.monotonically_increasing_id())
    assert [r[0] for r in refine.refined(tags, "tags", "t").orderBy("n").select("refined").collect()] == [[], [], ["电销违规"], [], ["欺骗投保人", "绝对化表述"], ["欺骗投保人", "绝对化表述"]]
