"""Row numbers over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.staging import staged


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``name`` from 1 in the given order: a range sort, row numbers in each part, and the counts of earlier parts (a row a part)."""
    taken = {f"__{name}_part"}
    part = taken.pop()
    d = staged(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = d.groupBy(part).count()
    base = counts.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias("__base"))
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return d.withColumn("__inner", inner).join(F.broadcast(base), part).withColumn(name, (F.col("__base") + F.col("__inner")).cast("long")).drop("__base", "__inner", part)
