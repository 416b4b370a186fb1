"""The compression classifier: held-out accuracy, odd rows, missing labels."""

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from docketry.llm import quality

LABELS = "doc_id long, quality int, toxic int, score double"


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "re", "mi", "so", "lu", "ne", "ka", "vo", "the", "and", "ing"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(30, 200)))
        good = int(i % 4 != 0)
        rows.append((i, text.capitalize() + "." if good else "!! ".join(text.upper().split()) + "###", good))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    # Labels of held-out rows are wrong: nothing may be learnt from them.
    labels = spark.createDataFrame([(i, g if zlib.crc32(str(i).encode()) % 5 else 1 - g, 0, 0.0) for i, _, g in rows], LABELS)
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and len(held) > 60
    assert all((got[i] >= quality.THRESHOLD) == bool(rows[i][2]) for i in held)
    again = {r.doc_id: r.score for r in quality.scored(docs.repartition(5), quality.train(docs.repartition(2), labels)).collect()}
    assert got == again


def test_whole_texts_count():
    """A text whose end differs has another score, however long it is."""
    good, bad = (["".join(np.random.default_rng(k).choice(list(a), 400)) for k in range(80)] for a in ("abcde ", "XYZ#! "))
    sizes = quality.Sizes(quality.dictionary([t.encode() for t in bad]), quality.dictionary([t.encode() for t in good]))
    start = "".join(np.random.default_rng(99).choice(list("abcde "), 300_000))
    m = sizes.measures(pa.array([start, start + bad[0] * 40, "", None, good[0], bad[0]]))
    assert m[0, 0] > m[1, 0] and m[2].tolist() == m[3].tolist() == [0.0, 1.0] and m[4, 0] > 0 > m[5, 0]


def test_sizes_are_those_of_the_library():
    d = quality.dictionary([b"a piece of text %d" % i for i in range(20)])  # too few to train
    assert zstandard.ZstdCompressionDict(d).dict_id() == 0 and quality.dictionary([]) == b""
    text = ("some words " * 700).encode()
    sizes = quality.Sizes(d, b"other words " * 20)
    expected = []
    for content in (d, b"other words " * 20):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=False, write_content_size=False, write_dict_id=False)
        expected.append(sum(len(c.compress(text[i : i + quality.PIECE_BYTES])) for i in range(0, len(text), quality.PIECE_BYTES)))
    bad, good = expected
    m = sizes.measures(pa.array(["x", text.decode()]))[1]
    assert np.allclose(m, [(bad - good) / (bad + good), min(bad, good) / len(text)])


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0, 0.5) for i in range(1, 18)] + [(None, 1, 1, 0.1), (3, None, None, None), (4, 0, 0, 0.0), (4, 1, 1, 1.0), (99, 0, 0, 0.0)], LABELS)
    got = quality.scored(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[5] == by[6]  # null and empty
    assert quality.scored(none, quality.train(odd, labels)).count() == 0
    nobody = {r.score for r in quality.scored(odd, quality.train(none, labels)).collect()}
    assert nobody == {labels.where(~quality.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("q")).agg(F.avg("q")).first()[0]}
    assert {r.score for r in quality.scored(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.scored(odd, quality.train(odd, labels.where("quality = 1"))).collect()} == {1.0}


def test_query_on_the_table(spark):
    from docketry.llm.common import read
    from docketry.llm.registry import queries

    folder = "/root/testdata/sf0.1"
    out = queries()["op12_quality"](spark, folder)
    rows = out.join(read(spark, folder, "labels"), "doc_id").where("held_out and quality is not null").select("score", "predicted", "quality").collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    scores, good = np.array([r.score for r in rows]), np.array([r.quality == 1 for r in rows])
    rank = scores.argsort().argsort()
    area = (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()
    kept = np.array([r.predicted == 1 for r in rows])
    assert area > 0.95 and kept[good].mean() > 0.99 and (~kept[~good]).mean() > 0.75
