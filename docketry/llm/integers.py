"""Vectors of integers: what the operators on quantised embeddings share.

Components become ``floor(scale * x)`` in double precision.  Integers saturate at ``limit(dimension)`` in size (2**27
for 64 components), so that a squared distance always fits into a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch of vectors.
VECTOR_ROWS = 2000
#: A key counts as hot if it holds this share of all rows or more; there are at most as many hot keys.
HOT_KEYS = 256
MOST = (1 << 63) - 1


def limit(dimension: int) -> int:
    return math.isqrt((1 << 60) // max(dimension, 1))


def is_finite(v: Column) -> Column:
    """Whether all components of a vector are there and finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(v: Column, scale: int, most: int) -> Column:
    whole = F.transform(v.cast("array<double>"), lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(float(-most))), F.lit(float(most)))))
    return whole.cast("array<int>")


def matrix(column: pa.Array) -> np.ndarray:
    """[row, component] of a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_long(total) -> int:
    """A sum as a long; sums beyond the type stop at its largest value."""
    return min(int(total), MOST)


def with_values(rows: DataFrame, values: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each ``key`` (nulls are a key) and its number of rows.

    Keys that hold 1/256 of all rows or more are at most 256: these are broadcast.  Of the others, none holds
    more than that share, so that no task of their shuffle gets more either.
    """
    total = values.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = values.where(F.col(size) * HOT_KEYS >= total)
    rest = values.where(F.col(size) * HOT_KEYS < total)
    columns = [F.col(f"r.{c}") for c in rows.columns] + [F.col(f"v.{c}") for c in values.columns if c != key]
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"v.{key}"))
    near = rows.alias("r").join(F.broadcast(hot.alias("v")), same).select(*columns)
    others = rows.alias("r").join(F.broadcast(hot.select(key).alias("v")), same, "left_anti")
    return near.unionByName(others.alias("r").join(rest.alias("v"), same).select(*columns))
