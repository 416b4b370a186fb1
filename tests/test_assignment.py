"""Pairing of extracted and gold cases, and the metrics over pairs."""

import itertools
import random

import pandas as pd

from docketry.operators import assignment

FIELDS = "party_name string, penalty_doc_no string, violation_behavior string, penalty_content string, regulator string, institution_type string, is_insurance_related boolean"


def side(spark, name, rows):
    return spark.createDataFrame(rows, f"file string, {name} int, {FIELDS}")


def test_pairs_against_all_permutations(spark):
    rng = random.Random(8)
    some = lambda: rng.choice([None, "", *"甲乙丙", "甲乙", "乙 丙甲", "丁" * 5])

    def cases(k, count):
        return [(f"f{k}", 100 * k + i, *(some() for _ in range(6)), None) for i in range(count)]

    sizes = [(rng.randrange(7), rng.randrange(7)) for _ in range(25)]
    g = [r for k, (n, _) in enumerate(sizes) for r in cases(k, n)]
    p = [r for k, (_, m) in enumerate(sizes) for r in cases(k, m)]
    pairs = assignment.matched(side(spark, "gold_id", g), side(spark, "pred_id", p), "file").collect()
    plain = lambda v: (v or "").replace(" ", "").strip()
    frame = lambda rows: pd.DataFrame([tuple(map(plain, r[2:7])) for r in rows], columns=["party_name", "penalty_doc_no", *assignment.LONG, "regulator"])
    for k, (n, m) in enumerate(sizes):
        gk, pk = [r for r in g if r[0] == f"f{k}"], [r for r in p if r[0] == f"f{k}"]
        mine = [r for r in pairs if r.file == f"f{k}"]
        both = [r for r in mine if r.gold_id is not None and r.pred_id is not None]
        assert sorted(r.gold_id for r in mine if r.gold_id is not None) == [r[1] for r in gk] and sorted(r.pred_id for r in mine if r.pred_id is not None) == [r[1] for r in pk]
        assert len(both) == min(n, m)
        if n and m:
            s = assignment.pair_scores(frame(gk), frame(pk))
            s = s if n <= m else s.T
            best = max(sum(s[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(s.shape[1]), s.shape[0]))
            assert abs(sum((s if n <= m else s.T)[r.gold_id - 100 * k, r.pred_id - 100 * k] for r in both) - best) < 1e-9


def test_large_files_and_no_cases(spark):
    g = [("f", i, f"公司{i % 3}", f"N{i}" if i % 2 else None, "", "", "", "", True) for i in range(20)] + [(None, 99, None, None, None, None, None, None, None)]
    p = [("f", i, f"公司{i % 3}", f"N{i}", "", "", "", "", True) for i in range(20)]
    gold, pred = side(spark, "gold_id", g), side(spark, "pred_id", p)
    pairs = assignment.matched(gold, pred, "file", max_cases=5).collect()
    assert len(pairs) == 21 and all(r.gold_id == r.pred_id for r in pairs if r.gold_id is not None and r.gold_id % 2 and r.gold_id != 99)
    both = [r for r in pairs if r.gold_id is not None and r.pred_id is not None]
    assert len(both) == 20 and all(r.gold_id % 3 == r.pred_id % 3 for r in both)
    none = assignment.matched(gold.limit(0), pred.limit(0), "file")
    assert none.count() == 0
    scores = assignment.case_metrics(assignment.side_by_side(none, gold, pred)).collect()
    assert len(scores) == 13 and all(r.n == 0 or r.part == "macro" for r in scores)


def test_noise(spark):
    g = [
        ("a", 1, "当事人名称：甲公司", "N1", "", "当事人" + "长" * 90, "", "", True), ("b", 2, "保险机构", "N2", "", "见原文", "", "", True), ("c", 3, "乙公司申请行政复议", "N3", "", "罚款", "", "", False),
        ("d", 4, "当事人名称", None, "", "", "", "", None),
    ]
    p = [("a", 1, "甲公司某分部", "N1第", "", "罚款", "", "", True), ("b", 2, "丙", "N2", "", "罚款", "", "", None), ("c", 3, "丁", "N9", "", "罚款", "", "", None), ("d", 4, "名称", None, "", "", "", "", True)]
    gold, pred = side(spark, "gold_id", g), side(spark, "pred_id", p)
    rows = {(r.part, r.field): r for r in assignment.case_metrics(assignment.side_by_side(assignment.matched(gold, pred, "file"), gold, pred)).collect()}
    party, number, content = (rows["adjusted", f] for f in ("party_name", "penalty_doc_no", "penalty_content"))
    assert (party.f1, party.excluded) == (1.0, 2) and (number.precision, number.excluded) == (0.6667, 0)
    assert (content.f1, content.excluded, content.n) == (1.0, 3, 1) and rows["insurance", "is_insurance_related"].n == 3
    assert rows["insurance", "is_insurance_related"].precision == 0.6667


def test_overlap_is_counted_within_a_row(spark):
    """Long texts of a pair are not dealt by their characters; the values are those of the general measure."""
    from docketry.operators.metrics import char_overlap, pair_overlap

    rows = [(1, "a b\u3000éa", "aé c"), (2, "", "x"), (3, None, " "), (4, "𝒳𝒳中", "中𝒳"), (5, "abc", "abc")]
    pairs = spark.createDataFrame(rows, "id int, g string, p string")
    values = lambda d: sorted(tuple(r) for r in d.select("precision", "recall", "f1").collect())
    found = pair_overlap(pairs, "g", "p")
    assert values(found) == values(char_overlap(pairs, "id", "g", "p")) and found.count() == 4
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
