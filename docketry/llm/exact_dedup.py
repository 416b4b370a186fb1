"""Exact deduplication over a log-structured merge index of digests, in DataFrame functions only.

* Memtable and flush: each input partition becomes one run, its SHA-256 digests sorted, with Parquet Bloom filters
  on the digest column (``flush``).  Nothing is shuffled.
* Compaction: runs are merged by digest; of each digest the smallest identifier ``(-code points, doc_id)`` and
  the number of rows remain (``compact``).  Partial aggregation meets hot digests before the shuffle.  A filter of
  fixed size holds the digests that occur more than once.
* Lookup and verification: rows that the filter rules out are unique and go no further.  The others are joined with
  the level, in as many parts as a digest's rows need; the bytes of a hit are compared with those of the row that
  stays.  Digests with unequal bytes are regrouped by the bytes themselves.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null counts as empty.
Defined results: a null ``doc_id`` orders before all others; rows that repeat the id and the length of the row
that stays are all marked kept by ``assign`` and reduced to one by ``deduplicated``; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import SPACE_CLASS, dropped, key_filter, maybe_in, read, release, scratch, stored

#: Rows of one digest that one task verifies.
HOT_ROWS = 1024

FLUSH_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def digest_of(text: Column, n_bytes: int = 32) -> Column:
    """First ``n_bytes`` of the SHA-256 of the normalised text; fewer than 32 only in tests of verification."""
    return F.substring(F.unhex(F.sha2(normalised(text).cast("binary"), 256)), 1, n_bytes)


class DigestIndex:
    """An index folder: ``run-*`` folders of flushed digests and one compacted level."""

    def __init__(self, spark: SparkSession, path: str | None = None, n_bytes: int = 32):
        self.spark, self.path, self.n_bytes = spark, path or scratch(spark, "lsm"), n_bytes
        self.runs = 0

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write one sorted run per partition of ``docs``; returns (digest, doc_id, n_cp, sha) of the batch."""
        path = f"{self.path}/run-{self.runs:06d}"
        self.runs += 1
        sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
        batch = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_cp"), F.unhex(sha).alias("sha"))
        batch = batch.select(F.substring("sha", 1, self.n_bytes).alias("digest"), "doc_id", "n_cp", "sha")
        batch.sortWithinPartitions("digest").write.options(**FLUSH_OPTIONS).parquet(path)
        return self.spark.read.schema(batch.schema).parquet(path)

    def compact(self) -> DataFrame:
        """Merge all runs: (digest, keep_cp, keep_id, group_size), sorted; ``repeated`` is the filter of its repeated digests."""
        runs = self.spark.read.parquet(*[f"{self.path}/run-{i:06d}" for i in range(self.runs)])
        best = F.min(F.struct((-F.col("n_cp")).alias("neg"), "doc_id"))
        level = runs.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
        level = level.select("digest", (-F.col("best.neg")).alias("keep_cp"), F.col("best.doc_id").alias("keep_id"), "group_size")
        path = scratch(self.spark, "lsm-level")
        level.sortWithinPartitions("digest").write.options(**FLUSH_OPTIONS).parquet(path)
        level = self.spark.read.schema(level.schema).parquet(path)
        self.repeated = key_filter(level.where("group_size > 1").select("digest"))
        return level


def _stays(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))


def unequal_digests(docs: DataFrame, index: DigestIndex, level: DataFrame) -> DataFrame:
    """Digests under which the bytes of some hit differ from those of the row that stays (stored)."""
    text = docs.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_cp"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        digest_of(F.col("text"), index.n_bytes).alias("digest"),
    )
    several = level.where("group_size > 1").withColumn("parts", F.ceil(F.col("group_size") / HOT_ROWS).cast("int"))
    hits = maybe_in(text, F.col("digest"), index.repeated).where("__maybe").join(several, "digest")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    hits = stored(hits.select("digest", "text", part.alias("part"), "parts", _stays().alias("stays")), "lsm-hits")
    # Of each digest one text is compared with all; rows that repeat its id and length are hits like the others.
    kept = hits.where("stays").groupBy("digest", "parts").agg(F.first("text").alias("kept_text"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pair = hits.join(kept, ["digest", "part"])
    # Distinct only after the table is written: nothing that needs a digest's rows together stands on the join.
    unequal = stored(pair.where(normalised(F.col("text")) != normalised(F.col("kept_text"))).select("digest"), "lsm-unequal")
    dropped(hits)
    release(docs.sparkSession)
    return unequal.distinct()


def regrouped(docs: DataFrame, bad: DataFrame, n_bytes: int) -> DataFrame:
    """Rows of digests with unequal bytes, grouped by the bytes: (doc_id, n_cp, sha, keep_cp, keep_id, group_size)."""
    rows = docs.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_cp"), normalised(F.col("text")).alias("norm"),
        digest_of(F.col("text"), n_bytes).alias("digest"),
    ).join(bad, "digest", "left_semi")
    best = F.min(F.struct((-F.col("n_cp")).alias("neg"), "doc_id"))
    groups = rows.groupBy("norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("norm", (-F.col("best.neg")).alias("keep_cp"), F.col("best.doc_id").alias("keep_id"), "group_size")
    return rows.join(groups, "norm").withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))


def assign(docs: DataFrame, n_bytes: int = 32) -> DataFrame:
    """(doc_id, n_cp, sha, keep_cp, keep_id, group_size, kept) of every row of ``docs``."""
    index = DigestIndex(docs.sparkSession, n_bytes=n_bytes)
    batch = index.flush(docs)
    level = index.compact()
    bad = unequal_digests(docs, index, level)
    out = ["doc_id", "n_cp", "sha", "keep_cp", "keep_id", "group_size"]
    if bad.isEmpty():
        rows = batch.join(level, "digest").select(*out)
    else:
        rows = batch.join(bad, "digest", "left_anti").join(level, "digest").select(*out)
        rows = rows.unionByName(regrouped(docs, bad, n_bytes).select(*out))
    return rows.withColumn("kept", _stays())


def deduplicated(docs: DataFrame, n_bytes: int = 32) -> DataFrame:
    """Rows of ``docs`` that stay, one for each class of equal texts, with all their columns.

    Texts that the filter of repeated digests rules out are not shuffled.
    """
    index = DigestIndex(docs.sparkSession, n_bytes=n_bytes)
    index.flush(docs)
    level = index.compact()
    bad = unequal_digests(docs, index, level)
    row = F.col("row")  # all columns of docs in one, so that none can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(F.col("text"), n_bytes).alias("digest"))
    rows = maybe_in(packed, F.col("digest"), index.repeated)
    text = F.coalesce(row["text"], F.lit(""))
    hits = rows.where("__maybe").join(level.where("group_size > 1"), "digest", "left")
    stays = F.col("keep_cp").isNull() | (row["doc_id"].eqNullSafe(F.col("keep_id")) & (F.length(text) == F.col("keep_cp")))
    out = [rows.where("not __maybe").select("row")]
    if bad.isEmpty():
        out.append(hits.where(stays).dropDuplicates(["digest"]).select("row"))
    else:
        good = hits.join(bad, "digest", "left_anti").where(stays).dropDuplicates(["digest"])
        same = hits.join(bad, "digest", "left_semi").select("row", normalised(row["text"]).alias("norm"), F.struct((-F.length(text)).alias("neg"), row["doc_id"].alias("id")).alias("place"))
        best = same.groupBy("norm").agg(F.min("place").alias("best"))
        best = same.join(best, "norm").where(F.col("place").eqNullSafe(F.col("best"))).dropDuplicates(["norm"])
        out += [good.select("row"), best.select("row")]
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP6_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm from documents),
g as (select norm, count(*) group_size, first(doc_id order by n desc, doc_id nulls first) keep_id from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id kept, sha256(t.norm) text_sha256
from t join g using (norm)
"""
