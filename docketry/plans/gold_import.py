"""Import of gold records: documents, cases and relations of subjects change together or not at all.

All three tables are made from one staged snapshot of the records, written as a new version, and switched over by one
commit.  A run that dies before it leaves the version before; a run that would change nothing writes no version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.operators.classify import entity_confidence, entity_type, normalized_name, tags_to_ids
from docketry.storage import commit, committed, stored

# What stands where a record names nothing, why a record is a candidate, and how it was made.
NO_PARTY, NO_TEXT, GOLD_REASON, GOLD_METHOD = "未知当事人", "见原文", "competition_gold", "gold"
TABLES = {
    "documents": "file_id string, file_name string, regulator string, raw_text string, parse_status string",
    "cases": "case_id string, file_id string, party_name string, institution_type string, penalty_doc_no string, violation_behavior string, penalty_content string, regulator string, "
    "related boolean, candidate boolean, candidate_reasons array<string>, risk_tags array<string>, risk_type_ids array<string>, case_summary string, confidence double, method string",
    "relations": "case_id string, raw_party_name string, normalized_name string, entity_type string, confidence double",
}
#: Columns of records: (case_id, file_id, line) and what a case holds; of records of one case the last line counts.
RECORD = "case_id file_id line party_name institution_type penalty_doc_no violation_behavior penalty_content regulator risk_tags case_summary confidence".split()


def _or(c: str, default: str) -> Column:
    text = strip(F.coalesce(F.col(c), F.lit("")))
    return F.when(text == "", default).otherwise(text)


class GoldTables:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def version(self) -> int | None:
        return max(committed(self.spark, self.path), default=None)

    def table(self, name: str) -> DataFrame:
        """A table as of the last commit; empty before the first."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/version={version}/{name}")

    def replace(self, **tables: DataFrame) -> int:
        """A new version of all tables; those not given stay."""
        version = -1 if (v := self.version()) is None else v
        for name, schema in TABLES.items():
            columns = [f.split(" ")[0] for f in schema.split(", ")]
            tables.get(name, self.table(name)).select(*columns).write.mode("overwrite").parquet(f"{self.path}/version={version + 1}/{name}")
        commit(self.spark, self.path, version + 1)
        return version + 1

    def merge(self, records: DataFrame, raw_texts: DataFrame) -> bool:
        """Whether the records (``RECORD``) and their raw texts (file_id, raw_text) changed anything.

        Documents keep what a record leaves open; cases are overwritten but for the reasons why they are candidates;
        relations of the records' cases are replaced.
        """
        last = F.max_by(F.struct(*[c for c in RECORD if c != "case_id"]), "line").alias("r")
        staged = stored(records.select(*RECORD).groupBy("case_id").agg(last).select("case_id", "r.*"), "gold")
        # The last record of a file that names a regulator names the document's.
        regulator = F.max_by("regulator", F.when(F.col("regulator").isNotNull(), F.col("line")))
        named = records.groupBy("file_id").agg(regulator.alias("regulator")).join(raw_texts.where("raw_text <> ''").dropDuplicates(["file_id"]), "file_id", "left")
        old, new = self.table("documents").alias("o"), named.alias("n")
        either = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        is_new = F.col("n.file_id").isNotNull()
        documents = old.join(new, F.col("o.file_id") == F.col("n.file_id"), "full").select(
            either("file_id"), F.when(is_new, F.concat("n.file_id", F.lit(".txt"))).otherwise(F.col("o.file_name")).alias("file_name"), either("regulator"), either("raw_text"),
            F.when(is_new, "done").otherwise(F.col("o.parse_status")).alias("parse_status"),
        )
        tags = F.coalesce("risk_tags", F.array().cast("array<string>"))
        before = self.table("cases").select("case_id", F.col("candidate_reasons").alias("known_reasons"))
        cases = staged.join(before, "case_id", "left").select(
            "case_id", "file_id", _or("party_name", NO_PARTY).alias("party_name"), "institution_type", F.nullif(F.col("penalty_doc_no"), F.lit("")).alias("penalty_doc_no"),
            _or("violation_behavior", NO_TEXT).alias("violation_behavior"), _or("penalty_content", NO_TEXT).alias("penalty_content"), "regulator",
            F.lit(True).alias("related"), F.lit(True).alias("candidate"), F.coalesce("known_reasons", F.array(F.lit(GOLD_REASON))).alias("candidate_reasons"),
            tags.alias("risk_tags"), tags_to_ids(tags).alias("risk_type_ids"), "case_summary", "confidence", F.lit(GOLD_METHOD).alias("method"),
        )
        party = F.col("party_name")
        relations = cases.select(
            "case_id", party.alias("raw_party_name"), normalized_name(party).alias("normalized_name"), entity_type(party).alias("entity_type"), entity_confidence(party).alias("confidence")
        )
        ids = staged.select("case_id")
        changed = {
            "documents": documents,
            "cases": self.table("cases").join(ids, "case_id", "left_anti").unionByName(cases),
            "relations": self.table("relations").join(ids, "case_id", "left_anti").unionByName(relations),
        }
        changed = {name: stored(rows.select(*self.table(name).columns), f"gold-{name}") for name, rows in changed.items()}
        same = lambda a, b: a.count() == b.count() and a.exceptAll(b).isEmpty()
        if all(same(rows, self.table(name)) for name, rows in changed.items()):
            return False
        self.replace(**changed)
        return True
