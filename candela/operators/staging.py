"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task should hash or sort at once.
PART_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a temporary folder serves a local session; on a cluster it would be another
    folder on every machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write and read again: the lineage ends there, and a lost executor costs nothing of what came before."""
    path = f"{shared_folder(df.sparkSession)}/staged-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that is costly a row: a small file is one task, however long its rows take."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows (``rows`` of them, counted before) by their ``key`` in parts of about PART_ROWS. Their number is fixed: parts that are merged or read
    by their bytes hold the more rows the narrower these are, and a task's tables grow with rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / PART_ROWS)), key)
