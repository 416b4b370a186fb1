"""The default retrieval backend as one plan over a batch of queries.

Queries are rewritten, encoded, and sent to a dense and a sparse channel; the original wording is a second dense
channel, and pseudo documents a third where a hook makes them.  The channels are merged, the pool is reranked, a model's
order is applied where there is one, and the results get their reasons.

Every model is a hook with a defined fallback: without one, rewriting appends dictionary terms, encoders hash tokens
into buckets, reranking counts common tokens, and the order of the reranker stays.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docketry.functions.text import TOKEN, tokens
from docketry.operators import retrieval as R
from docketry.storage import stored

# Characters of a case that the reranker reads, results of a query, bounds of a model's order.
PAIR_CHARS, TOP_K, KEEP_MIN, KEEP_MAX = 1200, 10, 3, 10
FUSION_SIZE = RERANK_CANDIDATES = 200
BUCKETS = 64
#: Text bytes whose tokens one task counts.
COUNTED_BYTES = 16 << 20
#: Tokens whose bucket a task remembers.
KNOWN_TOKENS = 1 << 18


def token_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, w): how often each token occurs; the sparse side of the offline encoder."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return texts.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("w"))


def hashed_vectors(counts: DataFrame, key: str) -> DataFrame:
    """(key, v): tokens hashed into buckets; the dense side of the offline encoder."""
    bucket = (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")
    sums = counts.groupBy(key, bucket.alias("bucket")).agg(F.sum("w").alias("w"))
    sums = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    return sums.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def text_vectors(texts: DataFrame, key: str) -> DataFrame:
    """(key, v) of (key, text): the rows of ``hashed_vectors``, each text counted where it is; only vectors are moved."""
    pattern, kind = re.compile(TOKEN), texts.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[str, int] = {}
        for batch in batches:
            kept, vectors = [], []
            for i, text in enumerate(batch.column("text")):
                found = Counter(pattern.findall(text.as_py() or ""))
                v = [0.0] * BUCKETS
                for token, n in found.items():
                    if (at := bucket.get(token)) is None:
                        at = bucket[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % BUCKETS
                    v[at] += n
                if found:
                    kept.append(i)
                    vectors.append(v)
                if len(bucket) > KNOWN_TOKENS:
                    bucket.clear()
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(kept, pa.int64())), pa.array(vectors, pa.list_(pa.float64()))], [key, "v"])

    counted = texts.select(key, F.lower("text").alias("text")).mapInArrow(count, StructType([StructField(key, kind), StructField("v", ArrayType(DoubleType()))]))
    sums = counted.groupBy(key).agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(BUCKETS)])
    return sums.select(key, F.array(*[f"v{i}" for i in range(BUCKETS)]).alias("v"))


def overlap_score(query: Column, case: Column) -> Column:
    """Share of a query's tokens that the beginning of a case holds; the offline reranker."""
    asked = tokens(query)
    return F.round(F.size(F.array_intersect(asked, tokens(F.substring(case, 1, PAIR_CHARS)))) / F.greatest(F.size(asked), F.lit(1)), 6)


@dataclass(frozen=True)
class Backend:
    """Hooks and sizes; ``rewrite`` and ``hyde`` add columns of these names to (qid, text), null where they have none."""

    rewrite: Callable[[DataFrame], DataFrame] | None = None
    hyde: Callable[[DataFrame], DataFrame] | None = None
    score: Callable[[Column, Column], Column] = overlap_score
    order: Callable[[DataFrame], DataFrame] | None = None
    depth: dict[str, int] = field(default_factory=lambda: dict(R.DEPTH))
    top_k: int = TOP_K

    def channels(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        """(qid, channel, case_id, score, rk) of all channels."""
        asked = (self.rewrite(queries) if self.rewrite else queries.withColumn("rewrite", F.lit(None).cast("string"))).withColumn("rewrite", F.coalesce("rewrite", "text"))
        # Texts are dealt by case once, in tasks of bounded bytes: tokens, buckets and vectors of a case are counted where it is.
        size = corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        tasks = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size.bytes // COUNTED_BYTES))
        counts = token_counts(corpus.select("case_id", "text").repartition(tasks, "case_id"), "case_id")
        vectors, n_queries, n_corpus = hashed_vectors(counts, "case_id"), queries.count(), size.n
        rewritten = token_counts(asked.select("qid", "rewrite"), "qid", "rewrite")
        sparse = R.sparse(rewritten, counts, self.depth["sparse"]).select("qid", F.lit("sparse").alias("channel"), "case_id", "score", "rk")
        sides = [("dense", rewritten), ("dense_raw", token_counts(queries, "qid"))]
        if self.hyde:
            sides.append(("dense_hyde", token_counts(self.hyde(queries).where("hyde <> ''").select("qid", "hyde"), "qid", "hyde")))
        # All wordings are one side, so that the corpus is read and dealt out once.
        asked = [hashed_vectors(side, "qid").select(F.concat_ws(":", F.lit(name), F.col("qid").cast("string")).alias("qid"), "v") for name, side in sides]
        near = R.dense(reduce(DataFrame.unionByName, asked), vectors, self.depth["dense"], n_queries * len(sides), n_corpus)
        key = F.split("qid", ":", 2)
        return sparse.unionByName(near.select(key[1].cast(queries.schema["qid"].dataType).alias("qid"), key[0].alias("channel"), "case_id", "score", "rk"))

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        """(qid, case_id, score, rk, channels): the best ``top_k`` of each query."""
        # Stored, so that Spark knows how small it is and need not shuffle the texts to it.
        merged = stored(R.max_merge(R.relabelled(stored(self.channels(queries, corpus), "backend-channels")), FUSION_SIZE).where(F.col("rk") <= RERANK_CANDIDATES), "backend-merged")
        pool = corpus.select("case_id", F.col("text").alias("case_text")).join(merged.select("qid", "case_id", "channels", F.col("rk").alias("recall_rank")), "case_id")
        scored = pool.join(queries, "qid").select("qid", "case_id", "channels", "recall_rank", self.score(F.col("text"), F.col("case_text")).alias("score"))
        best = R.top(scored, self.top_k, F.col("score").desc(), F.col("recall_rank"))
        if self.order is None:
            return best.select("qid", "case_id", "score", "rk", "channels")
        ordered = R.listwise(best.select("qid", "case_id", "score", "rk"), self.order(best), KEEP_MIN, min(KEEP_MAX, self.top_k))
        return ordered.join(best.select("qid", "case_id", "channels"), ["qid", "case_id"])


def backfilled_tags(results: DataFrame, case_tags: DataFrame, cases: int = 5, most: int = 5) -> DataFrame:
    """(qid, tags): the tags of the first results of a query, in their order, each once."""
    tags = results.where(F.col("rk") <= cases).join(case_tags, "case_id").select("qid", "rk", F.posexplode("tags").alias("pos", "tag"))
    first = tags.groupBy("qid", "tag").agg(F.min(F.struct("rk", "pos")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"])
    return first.groupBy("qid").agg(F.slice(listed, 1, most).alias("tags"))
