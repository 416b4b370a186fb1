"""Channels that run one by one, each on its own: one that fails leaves the others' results as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.storage import stored

STATUS = "channel string, ok boolean, error string, rows long"


def isolated(spark: SparkSession, channels: dict[str, Callable[[], DataFrame]], kind: str) -> tuple[DataFrame, DataFrame]:
    """(qid, channel, case_id, score, rk, reason) of all channels, and (channel, ok, error, rows) of each.

    ``kind`` is the type of ``qid``.  A channel is built and run as a job of its own, and its rows are stored: whatever it
    raises, in the plan or in a task, becomes its status, and its table is empty.
    """
    schema = f"qid {kind}, channel string, case_id string, score double, rk int, reason string"
    out, status = spark.createDataFrame([], schema), []
    for name, build in channels.items():
        try:
            found = build()
            reason = F.col("reason") if "reason" in found.columns else F.lit("")
            rows = found.select("qid", F.lit(name).alias("channel"), "case_id", F.col("score").cast("double").alias("score"), F.col("rk").cast("int").alias("rk"), reason.alias("reason"))
            rows = stored(rows, f"channel-{name}")
            status.append((name, True, None, rows.count()))
        except Exception as e:  # noqa: BLE001  that is what isolates it
            status.append((name, False, f"{type(e).__name__}: {e}"[:500], 0))
        else:
            out = out.unionByName(rows)
    return out, spark.createDataFrame(status, STATUS)
