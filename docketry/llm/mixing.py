"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / w`` (``u`` from a hash of its id and a seed, ``w`` its quality
weight), so that the order of keys is a weighted sample without replacement.  Every source gets a target number of
words; complete epochs of all its documents come first, and the rest is taken in key order up to the budget.

A source may hold any share of the rows.  Keys are mapped into (0, 1) by ``1 - u ** (1 / w)``, which keeps their
order; a source is cut into as many ranges of that value as its rows need, words are summed by range before
anything is sorted, and only rows of one range meet in a task.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a null ``doc_id`` hashes
as the empty string; rows that repeat an id are documents of their own, ordered by size; an empty table gives an
empty result.  Of the document at the edge of the budget the whole is taken if at least half of it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD_REGEX, read, release, stored, word_count

#: Rows that one key range of a source holds on average.
ROWS_PER_RANGE = 4096
#: No target exceeds so many times the words of its source.
MAX_EPOCHS = 3
#: Sampling weights by ``labels.quality``; 1 at least, so that no key range gets more than the largest times its share.
QUALITY_WEIGHTS = {1: 4.0, 0: 1.0, None: 2.0}
SEED = "mix-1"


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1] from the first 52 bits of the md5 of seed and id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def weight_of(quality: Column) -> Column:
    return F.when(quality == 1, QUALITY_WEIGHTS[1]).when(quality == 0, QUALITY_WEIGHTS[0]).otherwise(QUALITY_WEIGHTS[None])


def weighted(docs: DataFrame, labels: DataFrame | None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key, place): words, exponential key and its place in (0, 1) of each document."""
    rows = docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"))
    if labels is None:
        rows = rows.withColumn("w", F.lit(QUALITY_WEIGHTS[None]))
    else:
        quality = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
        rows = rows.join(quality, "doc_id", "left").withColumn("w", weight_of(F.col("q")))
    u = uniform(F.col("doc_id"), seed)
    return rows.select(
        "doc_id", "source", "size", (-F.log(u) / F.col("w")).alias("key"), (1.0 - F.pow(u, 1.0 / F.col("w"))).alias("place")
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: size, target words, number of key ranges.  Weights 1, 2, 3 repeat in code point order.

    The windows run over one row per source, never over documents.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * MAX_EPOCHS
    t = by_source.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", cap)
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = weights - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("total", total).withColumn("weights", weights)
    t = t.withColumn("capped", F.col("cap") * left_weight < left * F.col("weight"))
    full = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    full_weight = F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    level = (F.col("total") - full).cast("double") / (F.col("weights") - full_weight).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return t.select("source", "source_size", "n_rows", target.alias("target")).select(
        "source",
        "source_size",
        "target",
        F.greatest(F.lit(1.0), F.ceil(F.col("n_rows") / ROWS_PER_RANGE)).alias("ranges"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, copies): how often each document is taken."""
    rows = stored(weighted(docs, labels, seed), "mix-rows")
    targets = stored(source_targets(rows), "mix-targets")
    same_source = F.col("r.source").eqNullSafe(F.col("t.source"))
    placed = (
        rows.alias("r")
        .join(targets.alias("t"), same_source)
        .select("r.*", "t.source_size", "t.target", "t.epochs", F.floor(F.col("place") * F.col("ranges")).alias("range"))
    )
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("words_before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    same_range = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.range") == F.col("s.range"))
    ordered = placed.alias("p").join(sums.alias("s"), same_range).select("p.*", "s.words_before")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("words_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = ((F.col("size") > 0) & (before + F.col("size") / 2 <= budget)).cast("long")
    return ordered.select(
        "doc_id", "source", "size", "key", "source_size", "target", (F.col("epochs") + extra).alias("copies")
    )


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The mixed corpus: columns of ``docs``, each row repeated as often as it is taken.

    The decision for a source is its number of epochs and the last key taken, one row per source.  A larger weight
    only brings a document forward, so that most are decided by their id alone: taken at the least weight, or left
    at the greatest.  Only the rest is joined with its label.
    """
    taken = mix(docs, labels, seed)
    per_source = taken.groupBy("source").agg(
        F.min("copies").alias("epochs"), F.max(F.struct("copies", F.struct("key", "doc_id", "size").alias("last"))).alias("top")
    )
    per_source = stored(per_source.select("source", "epochs", F.col("top.copies").alias("most"), "top.last"), "mix-cut")
    release(docs.sparkSession)
    row = F.col("row")  # all columns of docs in one, so that none can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), uniform(F.col("doc_id"), seed).alias("u"))
    rows = packed.join(per_source, row["source"].eqNullSafe(F.col("source"))).drop("source")

    def extra(w: Column) -> Column:
        """Whether the document is taken once more than its source's epochs, if its weight is ``w``."""
        key, last, i = -F.log(F.col("u")) / w, F.col("last"), row["doc_id"]
        same = (key == last["key"]) & i.eqNullSafe(last["doc_id"]) & (word_count(row["text"]) <= last["size"])
        earlier = (key == last["key"]) & (i.isNull() & last["doc_id"].isNotNull() | F.coalesce(i < last["doc_id"], F.lit(False)))
        return (F.col("most") > F.col("epochs")) & ((key < last["key"]) | earlier | same) & F.coalesce(row["text"].rlike(WORD_REGEX), F.lit(False))

    if labels is None:
        decided = rows.withColumn("extra", extra(F.lit(QUALITY_WEIGHTS[None])))
    else:
        least, most = (extra(F.lit(x)) for x in (min(QUALITY_WEIGHTS.values()), max(QUALITY_WEIGHTS.values())))
        sure = rows.where(least == most).withColumn("extra", least)
        quality = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
        unsure = rows.where(least != most).join(quality, row["doc_id"] == quality["doc_id"], "left")
        decided = sure.unionByName(unsure.withColumn("extra", extra(weight_of(F.col("q")))).select(*sure.columns))
    copies = (F.col("epochs") + F.col("extra").cast("long")).cast("int")
    return decided.where(copies > 0).select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = rf"""
with quality as (select doc_id, max(quality) q from labels where doc_id is not null group by doc_id),
rows_ as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '{WORD_REGEX}')), 0)::bigint size,
    (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 1) / {float(1 << 52)}::double u,
    case when q = 1 then 4::double when q = 0 then 1::double else 2::double end w
  from documents d left join quality using (doc_id)),
keyed as (select *, -ln(u) / w key from rows_),
sources as (select source, sum(size)::bigint s from keyed group by source),
weighted as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 w, s * {MAX_EPOCHS} cap from sources),
filled as (
  select *, sum(s) over () total, sum(w) over () weights,
    coalesce(sum(cap) over (order by cap / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0) cap_before,
    coalesce(sum(w) over (order by cap / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0) w_before
  from weighted),
marked as (select *, cap * (weights - w_before) < (total - cap_before) * w capped from filled),
levels as (
  select *, (total - coalesce(sum(case when capped then cap end) over (), 0))::double
    / (weights - coalesce(sum(case when capped then w end) over (), 0))::double lvl from marked),
targets as (select source, s, case when capped then cap::double else lvl * w end target from levels),
epochs as (select *, case when s > 0 then floor(target / s)::bigint else 0 end e from targets),
ordered as (
  select k.doc_id, k.size, t.s, t.target, t.e,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) before
  from keyed k join epochs t on k.source is not distinct from t.source)
select doc_id, size, s::bigint source_size, target,
  ((e + case when size > 0 and before + size / 2::double <= target - e * s then 1 else 0 end) * size)::bigint taken
from ordered
"""
