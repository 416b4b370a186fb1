"""Classification by a table of key words: literal matches of any number of words, entries in the order of their levels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import bound, strip
from docketry.operators import classify, refine
from docketry.operators.checks import small
from docketry.storage import stored

#: Characters of key words that one automaton holds, and so what an executor keeps of the dictionary at a time.
AUTOMATON_CHARS = 4_000_000
# Tags and ids that a case may have, internal ids, tags of key words beside those of the dictionary.
MAX_TAGS, MAX_IDS, MAX_INTERNAL, EXTRA_TAGS = 12, 3, 5, 2


def _automaton(words: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def _matcher(shared, key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value)
        for batch in batches:
            hits = [list(dict.fromkeys(w for _, w in automaton.iter(t))) if t else [] for t in batch[text]]
            yield pd.DataFrame({key: batch[key], "word": hits})

    return run


def word_hits(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, word): the distinct words of ``words`` (word) that occur literally in each text, one row per word and text.

    One pass over the texts for each part of the dictionary of up to :data:`AUTOMATON_CHARS` characters (commonly one):
    an Aho-Corasick automaton finds all words of a part at once, so that the work does not grow with the number of words.
    Only one part at a time is held by the driver and by an executor.  Null and empty words and texts match nothing.
    """
    spark = texts.sparkSession
    wanted = words.select("word").where("word <> ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    parts = int(total // AUTOMATON_CHARS) + 1
    if parts > 1:
        wanted = stored(wanted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(2 * parts))), "words")
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, word array<string>"
    found = None
    for part in range(2 * parts if parts > 1 else 1):
        mine = wanted.where(F.col("part") == part).select("word") if parts > 1 else wanted
        shared = spark.sparkContext.broadcast([r.word for r in mine.collect()])
        if not shared.value:
            continue
        # mapInPandas names no column of the texts but these two, so that the scan reads only them.
        hits = texts.select(key, text).where(F.col(text) != "").mapInPandas(_matcher(shared, key, text), schema).select(key, F.explode("word").alias("word"))
        if parts > 1:
            hits = stored(hits, "hits")
            shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(key, F.lit(None).cast("string").alias("word")).where("false")
    return found


def matched_entries(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, internal_ids, display_tags): active entries one of whose key words a text holds, higher levels first, then by id.

    ``entries``: (risk_type_id, level int, display_tags array, keywords array, is_active boolean).  Tags of entries follow
    each other in the same order.  Texts without an entry have no row.
    """
    active = entries.where("is_active").select("risk_type_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("display_tags", F.array().cast("array<string>")).alias("display_tags"), "keywords")
    each = active.select("risk_type_id", F.explode("keywords").alias("word")).where("word <> ''").distinct()
    # Words of a text become entries by a join on the word; an entry counts once for a text.
    hits = word_hits(texts, key, text, each).join(small(each), "word").select(key, "risk_type_id").distinct()
    rows = hits.join(small(active.drop("keywords")), "risk_type_id").groupBy(key)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("down"), "risk_type_id", "display_tags"))).alias("e"))
    return listed.select(key, F.transform("e", lambda x: x["risk_type_id"]).alias("internal_ids"), F.flatten(F.transform("e", lambda x: x["display_tags"])).alias("display_tags"))


def rule_tags(display_tags: Column, by_words: Column) -> Column:
    """Struct (tags, method): tags of the dictionary and up to two more by key words, or those alone; how they were found."""
    def merged(x: Column) -> Column:
        extras = F.slice(F.array_except(x["words"], x["rule"]), 1, EXTRA_TAGS)
        ruled = F.size(x["rule"]) > 0
        method = F.when(ruled & (F.size(extras) > 0), "rule+cn_dict").when(~ruled & (F.size(x["words"]) > 0), "cn_dict").otherwise("rule")
        return F.struct(F.when(ruled, F.concat(x["rule"], extras)).otherwise(x["words"]).alias("tags"), method.alias("method"))

    rule = classify.normalize_tags(F.coalesce(display_tags, F.array().cast("array<string>")))
    return bound(F.struct(rule.alias("rule"), by_words.alias("words")), merged)


def classified(cases: DataFrame, key: str, text: str, entries: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(key, internal_ids, competition_ids, display_tags, method) of each case, by a model's tags or else by rules.

    ``answers``: (key, tags array) of a model, where there are any: cases with at least one canonical tag keep them (method
    ``llm_cn``) and have no internal ids.  Others: :func:`matched_entries` and key words.  All tags are refined by the text.
    Ids come from the tags, without any from the internal ids.  ``key`` tells cases apart.
    """
    empty = F.array().cast("array<string>")
    d = cases.select(key, F.col(text).alias("_text"), classify.predict_tags(F.coalesce(text, F.lit(""))).alias("_words"))
    d = d.join(matched_entries(cases, key, text, entries), key, "left")
    if answers is not None:
        d = d.join(answers.select(key, classify.normalize_tags(F.coalesce("tags", empty)).alias("_model")), key, "left")
    else:
        d = d.withColumn("_model", empty)
    modelled = (F.size(F.coalesce("_model", empty)) > 0) & (strip(F.coalesce("_text", F.lit(""))) != "")
    d = d.withColumn("_r", rule_tags(F.col("display_tags"), F.col("_words"))).withColumn("_m", modelled)
    d = d.select(
        key, "_text", F.when(F.col("_m"), F.col("_model")).otherwise(F.col("_r.tags")).alias("_tags"), F.when(F.col("_m"), "llm_cn").otherwise(F.col("_r.method")).alias("method"),
        F.when(F.col("_m"), empty).otherwise(F.slice(F.coalesce("internal_ids", empty), 1, MAX_INTERNAL)).alias("internal_ids"),
    )
    d = refine.refined(d, "_tags", "_text", "display_tags").withColumn("display_tags", F.slice("display_tags", 1, MAX_TAGS))
    roots = F.filter(F.array_distinct(F.transform("internal_ids", classify.flat_id)), lambda x: x != "")
    ids = bound(classify.tags_to_ids(F.col("display_tags")), lambda x: F.when(F.size(x) > 0, x).otherwise(roots))
    return d.select(key, "internal_ids", F.slice(ids, 1, MAX_IDS).alias("competition_ids"), "display_tags", "method")

