"""Lexical search of so many queries that they are dealt out as the documents are: blocks of queries meet blocks of documents.

The rows are those of ``FullTextIndex.search``: documents with all tokens of a query, or if there are none, with any; they rank
by tokens hit, then by occurrences, then by id.  A task takes its documents in chunks, those with the longest texts first.  In
a chunk each token is a bitmap of documents; the bitmaps of a query's tokens are added bit by bit, for many queries at once, so
that 64 documents are counted in a step.  Only documents that hit as many tokens as the k-th best so far are looked at one by
one; a chunk that holds fewer tokens of a query is passed over.

Bounds come from a first round: every query meets some of the longest documents, and what its k-th best reaches there is
the least that counts everywhere.  All documents take part in the second round, so bounds change the time and no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import TOKEN
from docketry.operators.fulltext import words
from docketry.storage import stored

#: Queries and text bytes of documents that meet in one task; text bytes of the documents of the first round.
QUERY_BLOCK, DOCUMENT_BYTES, FIRST_BYTES = 1 << 18, 128 << 20, 4 << 20
#: Postings and documents of a chunk; words of bitmaps that are added in one step; look-ups made in one step.
CHUNK_POSTINGS, CHUNK_DOCUMENTS, STEP_WORDS, STEP_LOOKUPS = 1 << 18, 4096, 1 << 14, 1 << 20
ROWS = "n long, n_tokens int, tokens string, h int, w double, case_id string, text string"
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, case_id, score, rk) of (qid, text) among (case_id, text): up to ``k`` documents of each query."""
    spark = queries.sparkSession
    named = queries.select("qid", F.array_distinct(words(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
    named = stored(named.withColumn("n", F.monotonically_increasing_id()), "blocks-asked")
    asked = named.select("n", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"), F.lit(1).alias("h"), F.lit(0.0).alias("w"))
    docs = docs.select("case_id", "text").where("case_id is not null and text is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    cores, n = spark.sparkContext.defaultParallelism, named.count()
    groups = max(1, -(-n // QUERY_BLOCK))
    bounded = _met(asked, _longest(docs), max(cores, groups), 1, k, _bounds, "n long, n_tokens int, tokens string, h int, w double")
    found = _met(stored(bounded, "blocks-bounded"), docs, groups, max(-(-cores // groups), -(-size // DOCUMENT_BYTES)), k, _found, "n long, case_id string, n_hits int, n_tokens int, w double")
    best = Window.partitionBy("n")
    found = found.withColumn("rk", F.row_number().over(best.orderBy(F.col("n_hits").desc(), F.col("w").desc(), "case_id"))).withColumn("most", F.max("n_hits").over(best))
    found = found.where((F.col("rk") <= k) & ((F.col("n_hits") == F.col("n_tokens")) | (F.col("most") < F.col("n_tokens"))))
    return found.join(named.select("n", "qid"), "n").select("qid", "case_id", F.col("n_hits").cast("double").alias("score"), "rk")


def _longest(docs: DataFrame) -> DataFrame:
    """The longest documents, about ``FIRST_BYTES`` of text: classes of lengths, and of the last class a share by hash."""
    level = F.floor(F.log2(F.octet_length("text") + 1) * 8)
    left, least, share = FIRST_BYTES, 0, 1.0
    for row in docs.groupBy(level.alias("level")).agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.col("level").desc()).collect():  # some 250 classes at most
        if row.bytes > left:
            least, share = row.level, left / row.bytes
            break
        left -= row.bytes
    kept = F.pmod(F.xxhash64("case_id"), F.lit(1000)) < int(share * 1000)
    return docs.where((level > least) | ((level == least) & kept))


def _met(asked: DataFrame, docs: DataFrame, groups: int, blocks: int, k: int, out: Callable, schema: str) -> DataFrame:
    """What ``out`` makes of each group of queries and each block of documents; a pair of them is one task."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("g", F.pmod("n", F.lit(groups)).cast("int")).withColumn("b", every(blocks))
    d = docs.withColumn("b", F.pmod(F.xxhash64("case_id"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))
    none = lambda kind: F.lit(None).cast(kind)
    q = q.select("g", "b", "n", "n_tokens", "tokens", "h", "w", none("string").alias("case_id"), none("string").alias("text"))
    d = d.select("g", "b", none("long").alias("n"), none("int").alias("n_tokens"), none("string").alias("tokens"), none("int").alias("h"), none("double").alias("w"), "case_id", "text")
    rows = q.unionByName(d).repartitionById(groups * blocks, (F.col("g") * blocks + F.col("b")).cast("int"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            of_docs = pc.is_valid(batch.column("case_id"))
            sides[0].append(batch.filter(pc.invert(of_docs)).select(["n", "n_tokens", "tokens", "h", "w"]))
            sides[1].append(batch.filter(of_docs).select(["case_id", "text"]))
        if sides[0] and sum(map(len, sides[0])):
            left, right = (pa.Table.from_batches(x).combine_chunks() for x in sides)
            yield from out(left, _Best(left, k).among(right)).to_batches(max_chunksize=1 << 16)

    return rows.drop("g", "b").mapInArrow(meet, schema)


def _bounds(left: pa.Table, best: _Best) -> pa.Table:
    """The queries again; those with k documents have what the last of these reaches."""
    return left.select(["n", "n_tokens", "tokens"]).append_column("h", pa.array(best.h, pa.int32())).append_column("w", pa.array(best.w, pa.float64()))


def _found(left: pa.Table, best: _Best) -> pa.Table:
    q, place = np.nonzero(best.hits)
    of = lambda name: left.column(name).take(pa.array(q))
    ids = pa.array(best.ids, pa.string()).take(pa.array(best.docs[q, place]))
    return pa.table({"n": of("n"), "case_id": ids, "n_hits": pa.array(best.hits[q, place], pa.int32()), "n_tokens": of("n_tokens"), "w": best.weights[q, place]})


class _Best:
    """The k best documents of each query of a table (tokens, h, w), kept while chunks of documents pass.

    ``hits``, ``weights``, ``docs``: [query, place], no hits where there is no document; ``docs`` are numbers in the order of
    ids.  ``h``, ``w``: what a document must reach; at equal weight the smaller id decides.
    """

    def __init__(self, left: pa.Table, k: int) -> None:
        tokens = pc.split_pattern(left.column("tokens").combine_chunks(), " ")
        encoded = tokens.flatten().dictionary_encode()
        self.token = encoded.indices.to_numpy()
        self.vocabulary = {t: i for i, t in enumerate(encoded.dictionary.to_pylist())}
        self.row = np.repeat(np.arange(len(left), dtype=np.int32), pc.list_value_length(tokens).to_numpy())
        self.h, self.w = (left.column(c).to_numpy().copy() for c in ("h", "w"))
        self.k, shape = k, (len(left), k)
        self.hits, self.weights, self.docs = np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape, np.int32)
        self.ids: list[str] = []

    def among(self, right: pa.Table) -> _Best:
        pattern = re.compile(TOKEN)
        ids, texts = right.column("case_id").to_pylist(), right.column("text")
        length = pc.binary_length(texts).to_numpy()
        self.ids = sorted(set(ids))
        number = {c: i for i, c in enumerate(self.ids)}
        of = np.array([number[c] for c in ids], np.int64)
        total = np.bincount(of, weights=length, minlength=len(self.ids))
        chunk: list[list[int]] = [[], [], []]
        members: list[int] = []
        order = np.lexsort((of, -total[of])) if len(of) else of
        before = -1
        for i in order.tolist():
            if of[i] != before:
                if len(members) >= CHUNK_DOCUMENTS or len(chunk[0]) >= CHUNK_POSTINGS:
                    self._chunk(members, *chunk)
                    chunk, members = [[], [], []], []
                members.append(before := int(of[i]))
            # Several texts of one id count as one document.
            for t, n in Counter(map(str.lower, pattern.findall(texts[i].as_py()))).items():
                if (at := self.vocabulary.get(t)) is not None:
                    chunk[0].append(at)
                    chunk[1].append(len(members) - 1)
                    chunk[2].append(n)
        if members:
            self._chunk(members, *chunk)
        return self

    def _chunk(self, members: list[int], tokens: list[int], docs: list[int], counts: list[int]) -> None:
        if not tokens:
            return
        n, members = len(members), np.array(members, np.int32)
        held, local = np.unique(np.array(tokens, np.int64), return_inverse=True)
        keys, at = np.unique(local * n + np.array(docs, np.int64), return_inverse=True)
        tf = np.bincount(at, weights=counts)
        token, doc = np.divmod(keys, n)
        bits = np.zeros((len(held), -(-n // 64)), np.uint64)
        np.bitwise_or.at(bits, (token, doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64))
        most = np.maximum.reduceat(tf, np.searchsorted(token, np.arange(len(held))))
        # Tokens of queries that the chunk holds, and what a document of it can reach with them.
        place = np.full(len(self.vocabulary), -1, np.int32)
        place[held] = np.arange(len(held), dtype=np.int32)
        there = place[self.token]
        some = there >= 0
        there, row = there[some], self.row[some]
        m = np.bincount(row, minlength=len(self.h))
        need = self.h + (np.bincount(row, weights=most[there], minlength=len(self.h)) < self.w)
        first = np.cumsum(m) - m
        open_ = np.flatnonzero((m > 0) & (m >= need))
        open_ = open_[np.argsort(m[open_], kind="stable")]
        step = max(1, STEP_WORDS // bits.shape[1])
        ends = np.flatnonzero(np.diff(m[open_], append=-1)) + 1
        for start, end in zip([0, *ends[:-1]], ends):
            for i in range(start, end, step):
                rows = open_[i : min(i + step, end)]
                wanted = there[first[rows][:, None] + np.arange(m[rows[0]])]
                self._step(rows, wanted, need[rows], bits, keys, tf, n, members)

    def _step(self, rows, wanted, need, bits, keys, tf, n, members) -> None:
        """Queries ``rows`` with equally many tokens ``wanted`` in a chunk."""
        planes = _added(bits, wanted)
        fit = _at_least(planes, need)
        many = np.flatnonzero(np.bitwise_count(fit).sum(1) > 4 * self.k)
        if len(many):
            cut = [p[many] for p in planes]
            fit[many] = _at_least(cut, np.maximum(need[many], _kth(cut, self.k)))
        q, word = np.nonzero(fit)
        which, bit = np.nonzero(np.unpackbits(fit[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        q, doc = q[which], word[which] * 64 + bit
        hits, weights = np.zeros(len(q), np.int32), np.zeros(len(q))
        size = max(1, STEP_LOOKUPS // wanted.shape[1])
        for i in range(0, len(q), size):
            some = slice(i, i + size)
            sought = wanted[q[some]].astype(np.int64) * n + doc[some, None]
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            hit = keys[at] == sought
            hits[some], weights[some] = hit.sum(1), (tf[at] * hit).sum(1)
        q = rows[q]
        good = (hits > self.h[q]) | ((hits == self.h[q]) & (weights >= self.w[q]))
        self._merge(q[good], hits[good], weights[good], members[doc[good]])

    def _merge(self, q, hits, weights, docs) -> None:
        if not len(q):
            return
        had = np.unique(q)
        old = np.nonzero(self.hits[had])
        old = had[old[0]], old[1]
        q = np.concatenate([q, old[0]])
        hits, weights, docs = (np.concatenate([x, kept[old]]) for x, kept in ((hits, self.hits), (weights, self.weights), (docs, self.docs)))
        order = np.lexsort((docs, -weights, -hits, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        q, place, order = q[best], place[best], order[best]
        self.hits[q, place], self.weights[q, place], self.docs[q, place] = hits[order], weights[order], docs[order]
        # With k documents, the last one is what others must reach.
        full = had[self.hits[had, -1] > 0]
        self.h[full], self.w[full] = self.hits[full, -1], self.weights[full, -1]


def _added(bits: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """How many of a query's bitmaps hold each document, as bits of that number: planes [query, word], lowest first."""
    planes = [bits[wanted[:, 0]]]
    for j in range(1, wanted.shape[1]):
        carry = bits[wanted[:, j]]
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
        if (j + 1).bit_length() > len(planes):
            planes.append(carry)
    return planes


def _at_least(planes: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Bitmap of the documents whose number is ``need`` or more."""
    more, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ALL)
    for i in reversed(range(len(planes))):
        bit = np.where(need >> i & 1, ALL, np.uint64(0))[:, None]
        more |= equal & planes[i] & ~bit
        equal &= ~(planes[i] ^ bit)
    return more | equal


def _kth(planes: list[np.ndarray], k: int) -> np.ndarray:
    """The k-th largest number of each query; 0 where there are fewer documents."""
    more, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ALL)
    out = np.zeros(len(planes[0]), np.int32)
    for i in reversed(range(len(planes))):
        above = equal & planes[i]
        enough = np.bitwise_count(more | above).sum(1) >= k
        out += enough.astype(np.int32) << i
        keep = np.where(enough, ALL, np.uint64(0))[:, None]
        more |= above & ~keep
        equal &= (planes[i] & keep) | (~planes[i] & ~keep)
    return out
