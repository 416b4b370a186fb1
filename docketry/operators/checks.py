"""Broadcast only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is sent to all executors.
MAX_BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else without, and Spark picks another join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
