"""The operators against brute force on odd rows, empty tables included."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import ann, bpe, exact_dedup, html_text, mixing, ngram_join, pii, token_files, toxicity, warc
from docketry.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, sets):
        if i is not None:
            least[g].append(i)
    return sorted(((i, len(s), min(least[g], default=None) if s else i) for g, (i, s) in zip(group, sets)), key=repr)


def test_ngram_join_matches_brute_force(odd, odd_rows, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(odd).collect()), key=repr)
    assert got == brute_components([(r[0], r[1]) for r in odd_rows])
    assert ngram_join.joined(none).count() == 0


def test_ngram_join_chains_and_hot_passages(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(70)]
        for k in range(12):  # drifting copies: neighbours link, ends need not
            words = base[k:] + [f"g{g}t{i}" for i in range(k)]
            rows.append((len(rows), " ".join(words)))
    for _ in range(60):  # a passage that many unlike documents share
        own = [f"u{x}" for x in rng.integers(0, 10**6, 60)]
        rows.append((len(rows), " ".join(own + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()), key=repr)
    assert got == brute_components(rows)
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {c for _, _, c in got}


def family_rows(seed, n_sets):
    """A family of copies with chance changes of many degrees, cut ones too, some linked only by way of others."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(80)]
    sub = [f"s{i}" for i in range(30)]
    texts = [" ".join(base)]
    for k in range(n_sets):
        words = list(base)
        for i in rng.choice(len(words), int(rng.integers(0, 7)), replace=False):
            words[i] = f"x{rng.integers(0, 10**6)}"
        if k % 5 == 0:
            words = words[: int(rng.integers(50, 80))]
        if k % 4 == 1:
            words = words[:70] + sub[:10]
        if k % 7 == 2:
            words = words + [f"y{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(1, 40)))]
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("direct, block, cell, star", [(64, 128, 1024, 2048), (6, 4, 16, 8)])
def test_ngram_join_long_lists_match_brute_force(spark, monkeypatch, direct, block, cell, star):
    for name, value in (("DIRECT_ROWS", direct), ("LIST_BLOCK", block), ("CELL_ROWS", cell), ("STAR_ROWS", star)):
        monkeypatch.setattr(ngram_join, name, value)
    seen = []
    rounds = ngram_join.difference_rows
    monkeypatch.setattr(ngram_join, "difference_rows", lambda *x: seen.append(1) or rounds(*x))
    rows = family_rows(11, 150) + [(1000 + i, t.replace("b", "q")) for i, t in family_rows(12, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert len(seen) > 1 or direct == 64


def test_parities_bound_the_difference_of_sets(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 900, 1100, 1500, 2100)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10], s[:3] + np.uint64(1 << 21)))) for s in sets]
    hashes, offsets = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits = [np.array(x, np.int64) for x in ngram_join.parities(hashes, offsets).to_pylist()]
    assert [len(b) * 64 for b in bits[:5]] == [1024, 1024, 2048, 2048, 4096]
    rows = [(i, b.tolist()) for i, b in enumerate(bits)]
    d = spark.createDataFrame(rows, "fp long, bits array<long>")
    halves = {r.fp: r.h for r in d.where("size(bits) > 16").select("fp", ngram_join.half(F.col("bits")).alias("h")).collect()}
    pairs = [(a, b) for a in range(10) for b in range(10) if a < b and max(len(bits[a]), len(bits[b])) <= 2 * min(len(bits[a]), len(bits[b]))]
    n = [len(s) for s in sets]
    table = spark.createDataFrame([(a, b, n[a], n[b], 0, False) for a, b in pairs], "a long, b long, na int, nb int, w int, long boolean")
    kept = {(r.a, r.b) for r in ngram_join.likely(table, d).collect()}
    for a, b in pairs:
        x, y = bits[a], bits[b]
        x, y = (np.array(halves[a]) if len(x) > len(y) else x), (np.array(halves[b]) if len(y) > len(x) else y)
        different = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert different <= len(np.setxor1d(sets[a], sets[b]))
        assert ((a, b) in kept) == (7 * different <= n[a] + n[b])


def test_ngram_join_cuts_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(40, 90, 500)
    rows = [(7, int(n), i, 0, i if i % 3 else 0) for i, n in enumerate(sizes)] + [(8, 50, i, 0, 1) for i in range(300)] + [(9, 50, i, 0, i) for i in range(5)]
    lists = spark.createDataFrame(rows, "token long, n int, fp long, pos int, root long").repartition(3)
    dealt = ngram_join.cells_of(lists, ngram_join.open_lists(lists, 32), 32)
    cells = defaultdict(list)
    for r in dealt.collect():
        cells[r.token, r.g1, r.i, r.g2, r.j].append(r)
    assert {c[0] for c in cells} == {7, 9}  # the list of one class is not dealt
    assert max(map(len, cells.values())) <= 4 * 32
    met = defaultdict(int)
    for (_, g1, i, g2, j), found in cells.items():
        for a in found:
            for b in found:
                if a.token == 7 and a.fp < b.fp and ((g1, i) == (g2, j) or a.first != b.first):
                    met[a.fp, b.fp] += 1
    assert set(met.values()) == {1}  # no pair twice, and none that can link left out
    n = {i: int(x) for i, x in enumerate(sizes)}
    assert all((a, b) in met for a in n for b in range(a + 1, 500) if 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b]))
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 4)
    test_ngram_join_chains_and_hot_passages(spark)


def test_exact_dedup(odd, odd_rows, none):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is not None, r[0] or 0, r[0]))
    expect = sorted(((r[0], min(groups[n])[3], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for r in odd_rows for n in [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")]), key=repr)
    for n_bytes in (32, 1):  # with one byte, digests collide and the bytes decide
        rows = exact_dedup.assign(odd, n_bytes).select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("h"), "kept").collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.h) for r in rows), key=repr) == expect
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    clash = odd.withColumn("_digest", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("_sha", F.lit(3)).withColumn("row", F.lit(4)).withColumn("keep_id", F.lit(5))
    for n_bytes in (32, 1):
        kept = exact_dedup.deduplicated(clash, n_bytes)
        assert kept.columns == clash.columns and {(r._digest, r.digest, r.row) for r in kept.collect()} == {(1, 2, 4)}
        got = sorted((-len(r.text or ""), r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
        assert got == sorted(min(g)[:3] for g in groups.values())
    assert exact_dedup.assign(none).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark, odd):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 9)), None if i % 9 == 0 else f"s{i % 5}", 1, 2) for i in range(2500)] + [(None, "a b", "s1", 1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, u int, last int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 2500, 3)] + [(None, 1)], "doc_id long, quality int")
    for lab in (None, labels):
        takes = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs, lab).collect() if r.copies and r.doc_id is not None}
        mixed = mixing.mixed_documents(docs, lab)
        assert mixed.columns == docs.columns
        counts = defaultdict(int)
        for r in mixed.collect():
            if r.doc_id is not None:
                counts[r.doc_id, len(r.text.split())] += 1
        assert counts == takes
    assert mixing.mixed_documents(odd.withColumn("row", F.lit(1)).withColumn("extra", F.lit(2)), labels).columns[-2:] == ["row", "extra"]


def test_mixing_targets_and_determinism(spark, odd, none):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = [tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(2)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()]
    assert sorted(out) == sorted(again)
    total = sum(r[2] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r[1]].append(r)
    assert math.isclose(sum(v[0][4] for v in by.values()), total, rel_tol=1e-9)
    for v in by.values():
        assert v[0][4] <= 3 * v[0][3] + 1e-6 and abs(sum(r[2] * r[5] for r in v) - v[0][4]) <= 7
        assert max(r[5] for r in v) - min(r[5] for r in v) <= 1 and max(r[5] for r in v) <= 3
    mixed = mixing.mixed_documents(docs)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r[0]: r[5] for r in out if r[5]}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns


def test_bpe_round_trip(odd, odd_rows, none):
    import tiktoken

    path, pattern = bpe.vocabulary_path()
    own = bpe.loaded(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rows = bpe.encoded(odd, path, pattern).collect()
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows), key=repr)
    assert got == sorted(((r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows), key=repr)
    assert bpe.digests(none, path, pattern).count() == 0


@pytest.mark.parametrize("text", ["ab" * 3000, "a" * 2000, "  \n\n x  y \t", "<|endoftext|> it's 12٣", "　  a  b \n"])
def test_bpe_single_texts(text):
    import tiktoken

    path, pattern = bpe.vocabulary_path()
    own = bpe.BytePairEncoding.from_file(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_token_files(spark, odd, odd_rows, none):
    from tokenizers import Tokenizer

    folder = scratch(spark, "test-shards")
    manifest = token_files.write_shards(odd, token_files.tokenizer_path(), folder)
    got = [tuple(r) for r in token_files.read_shards(manifest, folder).collect()]
    tok, start, expect = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
    for r in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        expect.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(expect, key=repr)
    assert token_files.read_shards(token_files.write_shards(none, token_files.tokenizer_path(), folder), folder).count() == 0
    data = token_files.frame(b"payload")
    assert token_files.unframe(data) == (b"payload", len(data))
    with pytest.raises(ValueError):
        token_files.unframe(data[:-1] + bytes([data[-1] ^ 1]))


def test_warc(spark):
    rows = [(i, f"http://x/{i}", None if i % 9 == 4 else f"<p>{i % 40} é</p>" * (1 + i % 5), i) for i in range(120)] + [(500, "http://x/500", "<p>é</p>" * 300_000, 1)] + [(7, None, "<p>7</p>", 1), (None, "u", "<p>null</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = scratch(spark, "test-warc")
    got = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=True).collect()
    by = defaultdict(list)
    for i, _, h, _ in rows:
        by[h or ""].append(-1 if i is None else i)
    def expected(i, h):
        first = max(by[h or ""])
        own = (-1 if i is None else i) == first
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        return i, len((h or "").encode()), digest, "response" if own else "revisit", None if own else first

    expect = sorted((expected(i, h) for i, _, h, _ in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expect
    html = {i: h or "" for i, _, h, _ in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response" and r.page_id != 7)
    none = pages.limit(0)
    assert warc.read_archives(warc.write_archives(none, folder), folder).count() == 0
    good = warc.record(1, "u", b"x", "A" * 32, None, False)
    with pytest.raises(ValueError):
        warc.parse(good)  # the digest is not that of the payload


def test_html_text():
    p = "Some words of a paragraph that is long enough. " * 4
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu</a></ul></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>{p}<p><b>{p}</article><div id=comments><p>{p}</div><footer>f</footer>"
    assert html_text.main_text(page) == " ".join(("Head & more " + p + p).split())
    for odd in (None, "", "<p", "<script>x", "&amp", "<nav>a", "<" * 1000, "<div>" * 3000, "a<b>c</b>d"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("a<b>c</b>d<br>e") == "acd e"


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 1.0)  # all queries are trial queries here: brute force to the last neighbour
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(60)]
    data += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0]), (504, [None] * 8), (None, [1.0] * 8), (400, [1.0] * 8)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v, np.float32).astype(float) for i, v in data if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q in [i for i in good if i % 20 == 0]:
        expect = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:20]
        assert [i for i, _ in got[q]] == [i for _, i in expect]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def recall_of(table, data, want_queries, k=20):
    got = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in want_queries:
        scores = data @ data[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores, kind="stable")[:k].tolist()))
    return hits / (k * len(want_queries))


def test_nearest_recall_with_a_small_part_of_the_table(spark, monkeypatch):
    """12,000 vectors in clusters, with production parameters: recall of 0.9 from a twentieth of the table."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 32))
    data = (centres[rng.integers(0, 300, 12_000)] + 0.25 * rng.normal(size=(12_000, 32))).astype(np.float32).astype(float)
    data /= np.linalg.norm(data, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(4)
    budgets, visit = [], ann.leaves_to_visit
    monkeypatch.setattr(ann, "leaves_to_visit", lambda *x: budgets.append(visit(*x)) or budgets[-1])
    assert recall_of(table, data, range(0, 12_000, 20)) >= 0.9
    depth = round(np.log2(12_000 / ann.LEAF_ROWS))
    assert budgets[0] / 2**depth < 0.05  # leaves of a tree are equal shares of the table


def test_nearest_splits_hot_parts(spark, monkeypatch):
    """Copies of one vector, which no tree can divide, in parts and blocks of few rows."""
    for name, value in (("PART_ROWS", 100), ("BLOCK_ROWS", 64), ("BLOCK_QUERIES", 8), ("LEAF_ROWS", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    data = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(600, 8))])
    data = data[rng.permutation(900)]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(data)], "vec_id long, embedding array<double>, id string").repartition(3)
    rows = ann.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert all(math.isclose(r.score, float((data[r.query_id] * data[r.vec_id]).sum()), rel_tol=1e-12, abs_tol=1e-12) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.query_id].append((-r.score, r.vec_id, r.rank))
    assert set(by) == set(range(0, 900, 20)) and all(len(v) == 20 and [x[2] for x in sorted(v)] == list(range(1, 21)) for v in by.values())
    assert recall_of(table, data, range(0, 900, 20)) >= 0.85  # ties that brute force orders by place


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        words = list(rng.choice(vocabulary, 30)) + (["vile", "wretchlo"] if toxic else [])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    scores = {r.doc_id: r.score for r in toxicity.scored(d, model).collect()}
    unseen = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((scores[i] >= 0.7) == (i % 6 == 0) for i in unseen)
    kept = toxicity.without_toxic(odd, lab.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.scored(none, model).count() == 0


def test_pii(spark, odd, none):
    rows = [
        (1, "Mail Jo@mail7.example.com or jo@MAIL7.example.com, call +1 (017) 555-7713, ip 97.51.17.173."), (2, "card 4539148803436467 and 4539 1488 0343 6467"),
        (3, "Mrs Anna Smith, Mr. John Smith, господин Иванов"), (4, "nothing here, 12 of 300."), (5, None), (6, ""), (1, "ip 97.51.17.173"),
    ]
    out = pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    one = max((r.text for r in by[1]), key=len)
    mails = re.findall(r"\S+@\S+\.example\.com", one)
    assert len(mails) == 2 and mails[0] == mails[1] and "jo@" not in one.lower() and "97.51.17.173" not in one
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and re.search(r"\d+\.\d+\.\d+\.\d+", one)[0] in min((r.text for r in by[1]), key=len)
    a, b = re.fullmatch(r"card (\d{16}) and ((?:\d{4} ?){4})", by[2][0].text).groups()
    assert a == b.replace(" ", "") and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(a))) % 10 == 0
    names = re.fullmatch(r"Mrs (\S+) (\S+), Mr\. (\S+) (\S+), господин ([А-Яа-я]+)", by[3][0].text).groups()
    assert names[1] == names[3] and any(names[0].startswith(n) for n in pii.GIVEN_FEMALE) and any(names[2].startswith(n) for n in pii.GIVEN_MALE)
    assert by[4][0].text == rows[3][1] and by[5][0].text is None and by[6][0].text == ""
    assert pii.replaced(odd).columns == [*odd.columns, "n_entities"] and pii.replaced(none).count() == 0


def iban_remainder(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_pii_checks_gender_and_full_formats(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ROUNDS", 2)
    phones = [f"+1 {n:02d} {m:02d}" for n in range(100) for m in range(0, 100, 2)]
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE00 3704 0044 0532 0130 00", 3), (2, "Dr John Smith met Mr John Smith", 0), (3, "Dr Emma Gray", 0), (4, "Mrs Emma Brown", 0)]
    rows += [(10 + i, "call " + ", ".join(phones[i : i + 500]), 0) for i in range(0, len(phones), 500)]
    out = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string, n_entities int")).collect()}
    assert out[1].n_entities == 3 and out[1].n_entities_ == 3
    a, b, c = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) and (GB\d\d[A-Z]{4}\d{14}), (DE\d\d(?: \d{4}){4} \d\d)", out[1].text).groups()
    assert iban_remainder(a.replace(" ", "")) == 1 == iban_remainder(b) and "3704 0044" not in out[1].text
    first, second = re.fullmatch(r"Dr (\S+ \S+) met Mr (\S+ \S+)", out[2].text).groups()
    assert first == second and any(first.startswith(n) for n in pii.GIVEN_MALE)
    assert any(out[3].text.split()[1].startswith(n) for n in pii.GIVEN_FEMALE) and out[3].text.split()[1] == out[4].text.split()[1]
    made = [re.sub(r"\D", "", x) for i in range(0, len(phones), 500) for x in out[10 + i].text[5:].split(", ")]
    assert len(set(made)) == len(phones) and not set(made) & {re.sub(r"\D", "", p) for p in phones}


def test_pii_names_without_title(spark):
    rows = [
        (1, "Mr John Smith came. Smith said: SMITH's car, John-Smith, smith, Smithers."), (2, "Dr. J. Smith left"), (3, "Mr John Paul Smith, Frau von der Leyen"),
        (4, "Mr 王小明 说 王小明来了"), (5, "Dr O'Neill and O'Neill’s dog"), (6, "Smith alone"), (7, "Mr أحمد and أحمد"),
    ]
    out = {r.doc_id: r.text for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given, name = re.match(r"Mr (\S+) (\S+) came", out[1]).groups()
    assert out[1] == f"Mr {given} {name} came. {name} said: {name.upper()}'s car, {given}-{name}, smith, Smithers."
    initial, other = re.fullmatch(r"Dr\. ([A-Z])\. (\S+) left", out[2]).groups()
    assert initial != "J" and other == name  # the same person in every text
    assert re.fullmatch(rf"Mr (?!John)\S+ (?!Paul)\S+ {name}, Frau von der (?!Leyen)\S+", out[3])
    assert "王" not in out[4] and "O'Neill" not in out[5] and "أحمد" not in out[7]
    assert out[6] == "Smith alone"


def test_html_text_after_removed_parts():
    p = "Some words of a paragraph that is long enough. " * 4
    text = " ".join(p.split())
    for page in (f"<div><p class=notice>x<p>{p}</div>", f"<ul><li class=share>a<li>b</ul><p>{p}", f"<div><div class=ad>x</div><p>{p}</div>", f"<div><section><div class=ad>x<b>y</section><p>{p}</div>"):
        assert text in html_text.main_text(f"<body>{page}</body>") and "x" not in html_text.main_text(f"<body>{page}</body>").split()
    page = f"<article><section id='social-history'><h2 id='form-and-function'>Head</h2><p class='related-findings'>{p}</section></article>"
    assert html_text.main_text(page) == "Head " + text


def test_html_text_keeps_what_wraps_the_page():
    p = "Some words of a paragraph that is long enough. " * 4
    text = " ".join(p.split())
    shapes = [
        f"<html><head><title>t</title><meta a><p>{p}", f"<head><title>x</title>{p}", f"<div class='content no-sidebar'><p>{p}</div>", f"<body><form><div><p>{p}</div></form></body>",
        f"<div title='a hidden gem'><p>{p}</div>", f"<div class=widget><p>{p}</p></div>", "<div>" * 1500 + f"<p>{p}" + "</div>" * 1500 + "<div>" * 1500 + "</div>" * 1500,
        f"<body class='has-banner'><div class='related-work search-results'><p>{p}</div></body>",
    ]
    for page in shapes:
        assert html_text.main_text(page) == text, page[:80]
    other = "Comments of readers go on and on for many more words than this. " * 12
    assert html_text.main_text(f"<div><p>{p}</div><div id=comments><p>{other}</div>") == text
    assert html_text.main_text(f"<div class=widget><p>{p}</p><div class=comments><p>{other[:300]}</div></div>") == text
    assert html_text.main_text("<p>a <span class=ad>b<span>c</span> d</span>e") == "a e"
    assert html_text.main_text(f"<div hidden><p>{p}</div><p>{p}") == text == html_text.main_text(f"<div style='DISPLAY : none'><p>{p}</div><p>{p}")


def test_html_density_against_a_second_computation():
    """Densities and sums of well-formed pages from the parser of the standard library, by the formulas alone."""
    from html.parser import HTMLParser
    from math import e, log

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.top = {"tag": "body", "kids": [], "c": 0, "t": 0, "lc": 0, "lt": 0}
            self.open, self.link = [self.top], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("a", "b"):
                self.open[-1]["t"] += 1
                self.open[-1]["lt"] += tag == "a"
                self.link += tag == "a"
                return
            self.open.append({"tag": tag, "kids": [], "c": 0, "t": 0, "lc": 0, "lt": 0})
            self.open[-2]["kids"].append(self.open[-1])

        def handle_endtag(self, tag):
            if tag in ("a", "b"):
                self.link -= tag == "a"
            else:
                self.open.pop()

        def handle_data(self, data):
            n = len(" ".join(data.split()))
            self.open[-1]["c"] += n
            self.open[-1]["lc"] += n if self.link else 0

    def totals(n):
        for k in n["kids"]:
            totals(k)
            for x in ("c", "lc", "lt"):
                n[x] += k[x]
            n["t"] += k["t"] + 1

    def density(n, page):
        c, t, lc, lt = n["c"], max(n["t"], 1), max(n["lc"], 1), max(n["lt"], 1)
        if not c:
            return 0.0
        base = log(c / max(c - n["lc"], 1) * lc + page * c + e)
        return max(0.0, c / t * log(max(c / lc * t / lt, 1.0)) / log(base))

    rng = np.random.default_rng(9)

    def page(depth):
        out = []
        for _ in range(int(rng.integers(1, 4))):
            kind = rng.integers(0, 4) if depth else rng.integers(1, 4)
            words = " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(1, 40))))
            out.append([f"<div>{page(depth - 1) if depth else ''}</div>", f"<p>{words}</p>", f"<p>{words} <a>{words}</a></p>", f"<section><b>{words}</b></section>"][kind])
        return "".join(out)

    for _ in range(40):
        html = page(4)
        tree = Tree()
        tree.feed(html)
        totals(tree.top)
        share = tree.top["lc"] / max(tree.top["c"], 1)
        want, todo = [], [tree.top]
        for n in todo:
            own = sum(density(k, share) for k in n["kids"]) if n["kids"] else density(n, share)
            want.append((n["tag"], n["c"], round(own, 6)))
            todo.extend(n["kids"])
        root, pieces = html_text.parsed(html)
        html_text.decide(root)
        html_text.without_removed(root, pieces)
        assert [(n.tag, n.chars, round(n.total, 6)) for n in html_text.measure(root)] == want


def test_html_table(spark):
    p = "Some words of a paragraph that is long enough. " * 4
    rows = [(1, "u", f"<p>{p}", "x"), (2, None, None, None), (3, "u", "", "x"), (1, "u", f"<p>{p}", "x"), (None, "u", "<nav>a</nav>", "x"), (4, "u", f"<p>{p}" * 3000, "x"), (5, "u", "  \n ", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()), key=repr)
    assert got == sorted(((i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h, _ in rows), key=repr)
    assert html_text.extracted(pages.limit(0)).count() == 0 and html_text.extracted(pages).columns == ["page_id", "url", "text", "n_chars"]
