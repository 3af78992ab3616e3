"""Validation events: one schema for every check, the strict wrapper, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "severity string, code string, message string, row bigint, row_id string, location string, metadata map<string,string>"


class ValidationFailed(ValueError):
    """Raised in strict mode when an error event exists."""


def fixed(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Events known on the driver: about files, headers and job parameters."""
    names = ["severity", "code", "message", "row", "row_id", "location", "metadata"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def event(severity: str | Column, code: str, message: Column | str, *, row: Column | None = None, row_id: Column | None = None, location: Column | None = None, metadata: dict[str, Column] | None = None) -> Column:
    """A struct of the event schema."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [y for k, v in (metadata or {}).items() for y in (F.lit(k), v.cast("string"))]
    return F.struct(
        lit(severity).alias("severity"), F.lit(code).alias("code"), lit(message).alias("message"), (row if row is not None else F.lit(None)).cast("bigint").alias("row"), (row_id if row_id is not None else F.lit(None)).cast("string").alias("row_id"),
        (location if location is not None else F.lit(None)).cast("string").alias("location"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("metadata"),
    )


def where_true(df: DataFrame, checks: list[tuple[Column, Column]]) -> DataFrame:
    """An event a row and (condition, event) whose condition holds, in one pass over ``df``."""
    found = F.array_compact(F.array(*(F.when(cond, e) for cond, e in checks)))
    return df.select(F.explode(found).alias("e")).select("e.*")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(events: DataFrame) -> DataFrame:
    """error_count, warning_count, info_count."""
    return events.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")))


def strict(events: DataFrame, what: str) -> DataFrame:
    """``events``, or ValidationFailed if any is an error."""
    n = events.where(F.col("severity") == "error").count()
    if n:
        raise ValidationFailed(f"{what} failed: {n} error(s)")
    return events
