"""Split-conformal intervals: an exact distributed quantile of calibration errors, intervals and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval of values with at most so many rows is brought to the driver.
FEW_ROWS = 50_000


def quantile(df: DataFrame, value: Column, level: float) -> float | None:
    """The exact quantile with linear interpolation, by narrowing an interval around it; null values are left out."""
    d = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    n, low, high = d.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = level * (n - 1)
    k = math.floor(at)
    below, inside = 0, n
    while inside > FEW_ROWS and low < high:
        share = lambda i: min(1.0, max(0.0, (i - below) / inside))  # noqa: B023, E731
        part = d.where(F.col("v").between(low, high))
        lo, hi = part.agg(F.percentile_approx("v", [max(0.0, share(k) - 0.01), min(1.0, share(k + 2) + 0.01)], 1000)).first()[0]
        under, within = part.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))).first()
        if below + under > k or below + under + within < min(k + 2, n) or within >= inside:
            break
        low, high, below, inside = lo, hi, below + under, within
    if low == high:
        return float(low)
    got = [r[0] for r in d.where(F.col("v").between(low, high)).orderBy("v").limit(k - below + 2).tail(2)] if inside > FEW_ROWS else sorted(r[0] for r in d.where(F.col("v").between(low, high)).collect())[k - below : k - below + 2]
    return got[0] + (got[-1] - got[0]) * (at - k)


def calibrate(df: DataFrame, truth: Column, predicted: Column, alpha: float = 0.10) -> float:
    """The margin at miscoverage ``alpha``."""
    n = df.count()
    if not n:
        raise ValueError("the calibration set must not be empty")
    return quantile(df, F.abs(truth - predicted), min(1.0, math.ceil((n + 1) * (1.0 - alpha)) / n))


def intervals(predicted: Column, margin: float, threshold: float = 0.35) -> dict[str, Column]:
    """Bounds clipped to [0, 1], width, and the flag, which looks at the unclipped width."""
    low, high = F.greatest(F.lit(0.0), predicted - margin), F.least(F.lit(1.0), predicted + margin)
    return {"lower_bound": low, "upper_bound": high, "interval_width": high - low, "is_high_uncertainty": F.lit(2 * margin > threshold)}


def coverage(df: DataFrame, truth: Column, low: Column, high: Column) -> DataFrame:
    return df.agg(F.avg(truth.between(low, high).cast("double")).alias("coverage"))
