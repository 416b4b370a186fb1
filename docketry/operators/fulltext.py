"""A stored full-text index: postings with positions and field weights, kept by deltas.

A batch of documents is analysed in one pass: each document gives one posting for each of its tokens, with the number
of occurrences, their weight (fields may weigh differently) and their positions.  Postings lie in folders by a hash of
the token, sorted by token, so that a query reads the folders, and in them the row groups, of its own tokens; positions
are read only for headlines.  Lists are cut into slices by document, so that no task gets a frequent one whole.  A later batch replaces the
documents it names and may delete others; it counts once its commit is written, so that a writer that dies between
leaves the index as it was, and the same batch can be written again.

A search finds, for each query, the documents with all its tokens, or if there are none, those with any; they rank by
tokens hit, then by weight, then by id.  It starts from the rarest tokens.  The documents that hold these (seeds) are
counted whole; a document with all tokens must be among them.  For queries that have none, the k-th best seed hits
``h`` tokens.  A document that hits as many must hit at least ``h - r`` of the tokens that are left when the ``r`` most
frequent ones are set aside, for any ``r < h``: so the long lists of frequent tokens are never paired with the queries,
but only looked up for the documents that the other tokens leave.  ``r`` is what makes pairs and look-ups least.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import TOKEN
from docketry.operators.checks import MAX_BROADCAST_ROWS
from docketry.operators.permits import Permit
from docketry.storage import commit, committed, scratch, shared_root, spread, stored

#: Text bytes of a batch whose postings (about four times as many) one task sorts and writes.
PART_BYTES = 8 << 20
#: Folders that postings are dealt to: one for each part of the first batch, within bounds; an index keeps its number.  More
#: would not make parts smaller, since the list of one very frequent token lies in one folder; slices do.
MIN_BUCKETS, MAX_BUCKETS = 4, 32
#: Rows of an Arrow batch of documents; texts may be long.
ARROW_ROWS = 256
#: Documents that seeds of a query should be, as a multiple of the results asked for.
SEEDS = 2
#: Documents up to which those that are looked up are sent to all executors (their ids only).
LOOKED_UP = 200_000
#: The form of the stored tables; it changes when they do.
FORM = 2
POSTINGS = "token string, case_id string, tf int, weight double, positions array<int>"
# Words of a headline.
MIN_WORDS, MAX_WORDS, MARK, END_MARK = 20, 50, "<mark>", "</mark>"


def words(text: Column) -> Column:
    """The tokens of a text in order, in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def analysed(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Postings of (case_id, the fields): positions run on from field to field."""
    pattern, weights = re.compile(TOKEN), list(fields.values())

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            lengths = []
            for texts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                for text in texts:
                    before = len(found)
                    found += pattern.findall(text or "")
                    lengths.append(len(found) - before)
            # Tokens are ASCII and ideographs.  Equal ones of a document come together, in their order in it.
            coded = pc.ascii_lower(pa.array(found, pa.string())).dictionary_encode()
            code, per_doc = coded.indices.to_numpy().astype(np.int64), np.array(lengths, np.int64).reshape(len(batch), len(weights)).sum(1)
            doc = np.repeat(np.arange(len(batch)), per_doc)
            at = np.arange(len(code)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            weight = np.repeat(np.tile(np.array(weights, np.float64), len(batch)), lengths)
            key = doc * len(coded.dictionary) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            tf = np.diff(first, append=len(order))
            total = np.bincount(np.repeat(np.arange(len(first)), tf), weights=weight[order], minlength=len(first))
            ends = pa.array(np.append(first, len(order)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[order[first]])), batch.column(0).take(pa.array(doc[order[first]])), pa.array(tf, pa.int32()),
                    pa.array(total, pa.float64()), pa.ListArray.from_arrays(ends, pa.array(at[order], pa.int32())),
                ],
                ["token", "case_id", "tf", "weight", "positions"],
            )

    return docs.select("case_id", *fields).mapInArrow(analyse, POSTINGS)


class FullTextIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float]) -> None:
        self.spark, self.path, self.fields = spark, path, fields

    @classmethod
    def over(cls, docs: DataFrame, fields: dict[str, float] | None = None) -> FullTextIndex:
        """A new index, in a scratch folder, over (case_id, the fields; ``text`` alone if none are named)."""
        index = cls(docs.sparkSession, scratch(docs.sparkSession, "fulltext"), fields or {"text": 1.0})
        index.write(docs)
        return index

    @classmethod
    def of(cls, docs: DataFrame, name: str, fields: dict[str, float] | None = None) -> FullTextIndex:
        """The index of a table that ``docs`` reads, built where there is none yet for its files as they are now.

        It is kept in the shared folder under the name, the form of the index, and a hash of the fields and of the files'
        paths, lengths and times.
        """
        spark = docs.sparkSession
        form = F.lit(f"{FORM} {fields}")
        files = spark.read.format("binaryFile").load(docs.inputFiles()).select(F.xxhash64(form, "path", "length", "modificationTime").alias("h"))
        mark = files.agg(F.count("*").alias("n"), F.bit_xor("h").alias("h")).first()
        index = cls(spark, f"{shared_root(spark)}/{name}-{mark.n}-{mark.h & (1 << 64) - 1:016x}", fields or {"text": 1.0})
        if not committed(spark, index.path):
            index.write(docs)
        return index

    def write(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """One batch: ``docs`` are added or replaced, the case ids of ``removed`` deleted; returns its number."""
        batches = committed(self.spark, self.path)
        batch = batches[-1] + 1 if batches else 0
        at = lambda table: f"{self.path}/{table}/batch={batch}"
        before = self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        try:
            rows = spread(docs.select("case_id", *self.fields))
            # The parts grow with the texts' bytes, not with tasks: how large these are depends on the cluster.
            bytes_ = docs.agg(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in self.fields), F.lit(0)))).first()[0] or 0
            parts = -(-bytes_ // PART_BYTES)
            if batch == 0:
                buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, parts))
                self.spark.range(buckets, buckets + 1).toDF("buckets").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")
            buckets = self._buckets()
            # A token of every document is one list: it is cut into slices, the more the larger the batch.
            slices = max(1, -(-parts // buckets))
            postings = analysed(rows, self.fields).withColumn("bucket", bucket_of(F.col("token"), buckets))
            # Each pair of bucket and slice is a task of its own: hashes of so few pairs would often fall together.
            part = (F.col("bucket") * slices + F.pmod(F.xxhash64("case_id"), F.lit(slices))).cast("int")
            postings = postings.repartitionById(buckets * slices, part)
            postings.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        finally:
            if before is None:
                self.spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            else:
                self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        # The number of rows with a token is what it is in this batch; replaced documents make it an upper bound.
        counts = self.spark.read.schema(POSTINGS + ", bucket int").parquet(at("postings")).groupBy("bucket", "token").agg(F.count("*").alias("df"))
        counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))
        if batches or removed is not None:
            named = docs.select("case_id")
            named = named if removed is None else named.unionByName(removed.select("case_id"))
            named.distinct().write.mode("overwrite").parquet(at("named"))
        commit(self.spark, self.path, batch)
        return batch

    def _buckets(self) -> int:
        return self.spark.read.schema("buckets long").parquet(f"{self.path}/layout").first().buckets

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{table}/batch={b}" for b in batches]
        return self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _sides(self, tokens: DataFrame) -> tuple[list[int], Callable[[DataFrame], DataFrame]]:
        """The folders of (token), and a broadcast hint if these tokens, and tables no larger, are few enough."""
        if not committed(self.spark, self.path):
            return [], lambda df: df
        seen = tokens.agg(F.count("*").alias("n"), F.collect_set(bucket_of(F.col("token"), self._buckets())).alias("buckets")).first()
        return seen.buckets, F.broadcast if seen.n <= MAX_BROADCAST_ROWS else lambda df: df

    def postings(self, tokens: DataFrame, columns: list[str], sides=None) -> DataFrame:
        """Current postings of ``tokens`` (token): only the folders of their hashes are read."""
        batches, (buckets, side) = committed(self.spark, self.path), sides or self._sides(tokens)
        if not batches:
            return self.spark.createDataFrame([], POSTINGS).select("token", "case_id", *columns)
        p = self._read("postings", POSTINGS + ", bucket int", batches).where(F.col("bucket").isin(buckets))
        p = p.select("token", "case_id", *columns, "batch").join(side(tokens.select("token").distinct()), "token", "left_semi")
        if len(batches) > 1:
            newest = self._read("named", "case_id string", batches[1:]).groupBy("case_id").agg(F.max("batch").alias("newest"))
            p = p.join(newest, "case_id", "left").where(F.col("newest").isNull() | (F.col("batch") >= F.col("newest")))
        return p.select("token", "case_id", *columns)

    def frequencies(self, tokens: DataFrame, sides=None) -> DataFrame:
        """(token, df) of those of ``tokens`` that documents hold; an upper bound after replacements."""
        batches, (buckets, side) = committed(self.spark, self.path), sides or self._sides(tokens)
        if not batches:
            return self.spark.createDataFrame([], "token string, df long")
        t = self._read("terms", "token string, df long, bucket int", batches).where(F.col("bucket").isin(buckets))
        t = t.join(side(tokens.select("token").distinct()), "token", "left_semi")
        return t.select("token", "df") if len(batches) == 1 else t.groupBy("token").agg(F.sum("df").alias("df"))

    def search(self, queries: DataFrame, k: int, permit: Permit | None = None, mode: str = "and_or") -> DataFrame:
        """(qid, case_id, n_hits, weight, n_tokens, rk) of (qid, text).

        ``mode`` "and" gives documents with all tokens only.  Under a permit, what is best is best among what it permits.
        """
        asked = queries.select("qid", F.array_distinct(words(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
        asked = asked.select("qid", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
        asked = stored(asked, "fulltext-asked")
        sides = self._sides(asked)
        side = sides[1]  # tables of the queries' tokens are all as small as this one
        rarity = Window.partitionBy("qid").orderBy("df", "token")
        known = asked.join(self.frequencies(asked, sides), "token")
        known = known.withColumn("place", F.row_number().over(rarity)).withColumn("before", F.sum("df").over(rarity) - F.col("df"))
        known = stored(known, "fulltext-known")
        postings = self.postings(asked, ["weight"], sides)
        sought = known.groupBy("qid", "n_tokens").agg(F.collect_list("token").alias("tokens"))

        def read(tokens: DataFrame) -> DataFrame:
            """(qid, case_id, hits) by the postings of (qid, token), of what the queries may find."""
            pairs = postings.select("token", "case_id").join(side(tokens.select("qid", "token")), "token").groupBy("qid", "case_id").agg(F.count("*").alias("hits"))
            return permit.pairs(pairs) if permit else pairs

        def counted(pairs: DataFrame) -> DataFrame:
            """(qid, case_id, n_hits, weight, n_tokens): all tokens of the query, looked up for these documents."""
            pairs = stored(pairs.select("qid", "case_id"), "fulltext-pairs")
            ids = stored(pairs.select("case_id").distinct(), "fulltext-ids")
            # Only the postings of documents that are looked up leave the scan, as long as these are few.
            held = postings.join(F.broadcast(ids), "case_id", "left_semi") if ids.count() <= LOOKED_UP else postings
            profiles = held.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("held"))
            # A query's tokens are few, a case's may be thousands: they meet last, and only counts leave that join.
            found = pairs.join(side(sought), "qid").join(profiles, "case_id")
            hit = F.array_intersect(F.map_keys("held"), F.col("tokens"))
            weight = F.aggregate(hit, F.lit(0.0), lambda a, t: a + F.element_at("held", t))
            return found.select("qid", "case_id", F.size(hit).alias("n_hits"), weight.alias("weight"), "n_tokens")

        best = Window.partitionBy("qid").orderBy(F.col("n_hits").desc(), F.col("weight").desc(), F.col("case_id"))

        def ranked(scored: DataFrame) -> DataFrame:
            return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)

        seeds = stored(counted(read(known.where((F.col("place") == 1) | (F.col("before") < SEEDS * k)))), "fulltext-seeds")
        whole = seeds.where(F.col("n_hits") == F.col("n_tokens"))
        if mode == "and":
            return ranked(whole)
        rest = known.join(side(whole.select("qid").distinct()), "qid", "left_anti")
        kth = ranked(seeds).where(F.col("rk") == k).select("qid", F.col("n_hits").alias("h"))
        plan = rest.groupBy("qid").agg(F.array_sort(F.collect_list("df")).alias("dfs")).join(kth, "qid", "left").withColumn("h", F.coalesce("h", F.lit(1)))
        plan = plan.select("qid", "h", set_aside(F.col("dfs"), F.col("h")).alias("r"), F.size("dfs").alias("n"))
        essential = stored(rest.join(plan, "qid").where(F.col("place") <= F.col("n") - F.col("r")), "fulltext-essential")
        need = side(essential.groupBy("qid").agg(F.max(F.col("h") - F.col("r")).alias("need")))
        left = read(essential).join(need, "qid").where(F.col("hits") >= F.col("need"))
        return ranked(whole).unionByName(ranked(counted(left)))

    def containing(self, keyword: str) -> DataFrame:
        """(case_id) of the documents that hold all tokens of a keyword; none if it has no token."""
        asked = self.spark.range(1).select(F.explode(F.array_distinct(words(F.lit(keyword)))).alias("token"))
        found = self.postings(asked, []).groupBy("case_id").agg(F.count("*").alias("n"))
        return found.join(F.broadcast(asked.agg(F.count("*").alias("n"))), "n").select("case_id")  # one row

    def headlines(self, results: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
        """(qid, case_id, headline) of (qid, case_id): the densest window of at most 50 words, hits marked.

        The window starts at a hit; of equally dense ones the first.  It ends at its last hit, or after 20 words if that
        is later.  ``texts`` (case_id, text) are the texts of the first field; null where no word of it is hit.
        """
        asked = stored(queries.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("token")), "fulltext-asked")
        sides = self._sides(asked)
        wanted = results.select("qid", "case_id").join(sides[1](asked), "qid")
        places = wanted.join(self.postings(asked, ["positions"], sides), ["case_id", "token"])
        parts = results.select("qid", "case_id").join(texts.select("case_id", word_parts(F.col("text")).alias("parts")), "case_id")
        hits = places.select("qid", "case_id", "token", F.explode("positions").alias("at"))
        hits = hits.join(parts.select("qid", "case_id", (F.size("parts") - 1).alias("n_words")), ["qid", "case_id"]).where(F.col("at") < F.col("n_words"))
        ahead = Window.partitionBy("qid", "case_id").orderBy("at").rangeBetween(0, MAX_WORDS - 1)
        hits = hits.withColumn("n", F.count("*").over(ahead)).withColumn("last", F.max("at").over(ahead))
        densest = F.max_by(F.struct("at", "last", "n_words"), F.struct("n", (-F.col("at")).alias("early")))
        windows = hits.groupBy("qid", "case_id").agg(densest.alias("w"), F.collect_set("token").alias("tokens"))
        size = F.least(F.greatest(F.col("w.last") - F.col("w.at") + 1, F.lit(MIN_WORDS)), F.col("w.n_words") - F.col("w.at"))
        windows = windows.select("qid", "case_id", F.col("w.at").alias("start"), size.alias("size"), "tokens")
        cut = parts.join(windows, ["qid", "case_id"], "left").select("qid", "case_id", F.slice("parts", F.coalesce("start", F.lit(0)) + 2, F.coalesce("size", F.lit(0))).alias("cut"), "size", "tokens")
        return cut.select("qid", "case_id", F.when(F.col("size") > 0, shown(F.col("cut"), F.col("tokens"))).alias("headline"))


def set_aside(dfs: Column, h: Column) -> Column:
    """How many of the most frequent tokens (``dfs`` ascending) need not be read: 0 to ``h - 1``.

    With ``r`` of them set aside, the others are read; at most one in ``h - r`` of what is read is a document with that
    many hits, and for each ``r`` tokens are looked up.
    """
    def cost(r: Column) -> Column:
        read = F.aggregate(F.slice(dfs, 1, F.size(dfs) - r), F.lit(0).cast("double"), lambda a, x: a + x)
        return read * (1.0 + r / (h - r))

    choices = F.transform(F.sequence(F.lit(0), F.least(h, F.size(dfs)).cast("int") - 1), lambda r: F.struct(cost(r).alias("cost"), (-r).alias("minus")))
    return -F.array_min(choices)["minus"]


def word_parts(text: Column) -> Column:
    """What stands before the first word of a text, then each word with what follows it, set off by a control character."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "(" + TOKEN + ")", "\u0001$1\u0002"), "\u0001")


def shown(cut: Column, tokens: Column) -> Column:
    """Some parts as a text, with the words among ``tokens`` marked; nothing follows the last word."""
    def one(part: Column) -> Column:
        word, gap = F.substring_index(part, "\u0002", 1), F.substring_index(part, "\u0002", -1)
        return F.concat(F.when(F.array_contains(tokens, F.lower(word)), F.concat(F.lit(MARK), word, F.lit(END_MARK))).otherwise(word), F.lit("\u0002"), gap)

    joined = F.array_join(F.transform(cut, one), "\u0001")
    return F.regexp_replace(F.regexp_replace(joined, "\u0002[^\u0001\u0002]*$", ""), "[\u0001\u0002]", "")
