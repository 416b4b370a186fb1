"""Sinks: exports as JSON lines and CSV, and the projections they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(cases: DataFrame) -> DataFrame:
    """Candidates only, under ids of their own."""
    return cases.where("candidate").withColumn("candidate_id", F.concat(F.lit("CC"), F.regexp_replace("case_id", "^C+", "")))


def manifest(documents: DataFrame) -> DataFrame:
    """Documents that are done, by id."""
    return documents.where("parse_status = 'done'").select("file_id", F.col("file_name").alias("source_file"), F.lit("parsed").alias("note")).orderBy("file_id")


def cells(df: DataFrame) -> DataFrame:
    """Every column as text: null blank, dates ISO, lists joined, maps and structs JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array<string"):
            c = F.array_join(c, "、")
        elif kind.startswith(("map", "struct", "array")):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions; non-ASCII text as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def split_valid(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions that are complete, and the others with what is wrong with them."""
    reason = (
        F.when(F.coalesce("question_id", F.lit("")) == "", "question_id missing")
        .when(F.coalesce("risk_type", F.lit("")) == "", "risk_type empty")
        .when(F.coalesce(F.size("case_ids"), F.lit(0)) < 1, "no cases")
    )
    marked = submissions.withColumn("error", reason)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
