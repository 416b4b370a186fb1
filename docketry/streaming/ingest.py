"""Ingestion as a stream of files: contents seen before are left out by the stream's state, new ones parsed and appended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry.operators.extract import confidence, decision_date, fields, regulator
from docketry.operators.review import normalize_ocr

SCHEMA = "file_id string, digest string, party_name string, penalty_doc_no string, regulator string, level string, day string, fine_amount string, confidence double"


def extracted(texts: DataFrame) -> DataFrame:
    """Records of (file_id, text): repaired, with the fields found and the confidence in them."""
    d = texts.select("file_id", F.sha2("text", 256).alias("digest"), normalize_ocr(F.col("text")).alias("t"))
    found = fields(F.col("t"))
    name, level = regulator(F.col("t"), found["penalty_doc_no"])
    d = d.select("file_id", "digest", *[c.alias(n) for n, c in found.items()], name.alias("regulator"), level.alias("level"), decision_date(F.col("t")).alias("day"))
    filled = {n: F.col(n) for n in (*found, "regulator")} | {"publish_date": F.col("day")}
    score = confidence(filled, {"regulator": F.col("level")}, F.lit("regex"))
    return d.withColumn("confidence", score).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def first_of_each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The file with the smallest name of a content that no earlier batch had; the state is that it has been seen."""
    least = min((row for batch in batches for row in zip(batch["file_id"], batch["text"])), key=lambda r: r[0], default=None)
    if least is not None and not state.exists:
        state.update((True,))
        yield pd.DataFrame([least], columns=["file_id", "text"])


def start(spark: SparkSession, uploads: str, table: str, checkpoint: str):
    """Stream of text files below ``uploads`` into the Parquet ``table``, each content once.

    Which contents have been seen is state of the stream, by digest, so that a batch costs what its own files cost,
    however large the table is; state and the sink's log let a batch that is run again add nothing twice.
    """
    texts = spark.readStream.format("text").option("wholetext", "true").load(uploads)
    files = texts.select(F.col("_metadata.file_name").alias("file_id"), F.col("value").alias("text"), F.sha2("value", 256).alias("digest"))
    new = files.groupBy("digest").applyInPandasWithState(first_of_each, "file_id string, text string", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    sink = extracted(new).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start()
