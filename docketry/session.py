"""Session settings that the engine relies on; values a caller has set are left alone unless results depend on them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Settings that change results if they differ.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Python workers import this package by name; where it is not installed they find it beside the driver's copy.
    environment = spark.sparkContext.environment
    path = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in path:
        environment["PYTHONPATH"] = os.pathsep.join([*path, ROOT])
    return spark


def local_session(cpus: int = 8, app: str = "docketry") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return configure(builder.getOrCreate())
