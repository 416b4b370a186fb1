"""What queries share: tables, inline rows for Spark and SQL, the projection of the test tables onto the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import numbered

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]" + ("" if v else "::varchar[]")
    if isinstance(v, float):
        return f"{v!r}::double"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(names: str, data: list[tuple]) -> str:
    """The same inline rows as a SQL relation."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in data)
    return f"(select * from (values {body}) _v({names}))"


def rounded(c: Column) -> Column:
    return F.round(c, 6)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases: text is the behaviour, source the regulator, quality and toxicity the two flags."""
    labels = table(spark, sf_dir, "labels")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            numbered("C", F.col("doc_id")).alias("case_id"),
            "doc_id",
            F.col("text").alias("violation_behavior"),
            F.col("source").alias("regulator"),
            F.col("lang").alias("institution_type"),
            flag("quality").alias("related"),
            flag("toxic").alias("candidate"),
        )
    )


CASES_SQL = """(select printf('C%06d', d.doc_id) case_id, d.doc_id, text violation_behavior, source regulator, lang institution_type,
  coalesce(quality = 1, false) related, coalesce(toxic = 1, false) candidate from documents d left join labels using (doc_id))"""
