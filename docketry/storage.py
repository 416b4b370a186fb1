"""Tables that steps write for other steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one is set only where that is unset.

    Only a local master may go without the setting: executors elsewhere would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its files give fewer tasks than there are; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a table has a commit for, in order; none where nothing is there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    success = lambda at: spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if files.exists(success(f.getPath())))


def commit(spark: SparkSession, path: str, batch: int) -> None:
    """From now on the batch counts: what was written for it before is whole."""
    spark.range(batch, batch + 1).toDF("batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")
