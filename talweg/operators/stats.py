"""Aggregates over evaluation and usage logs; each is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def _bucket(log: DataFrame, at: str, unit: str) -> Column:
    """Start of the hour or day, of the same type as the time itself: one without zone stays without, whatever the session's zone."""
    start = F.date_trunc(unit, at)
    return (start.cast("timestamp_ntz") if dict(log.dtypes)[at] == "timestamp_ntz" else start).alias("bucket")


def evaluation_statistics(log: DataFrame, metrics: Sequence[str], status: str = "status", duration: str = "duration_ms") -> DataFrame:
    """Counts of completed, pending and failed rows; avg, min and max of each metric and the average duration of completed ones.

    An average, minimum or maximum of exactly 0 is null, like one of no rows.
    """
    done = F.col(status) == "completed"
    aggs = [F.count_if(done).alias("completed_count"), F.count_if(F.col(status) == "pending").alias("pending_count"), F.count_if(F.col(status) == "failed").alias("failed_count")]
    for m in metrics:
        value = F.when(done, F.col(m))
        aggs += [_null_if_zero(f(value)).alias(f"{name}_{m}") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return log.agg(*aggs, _null_if_zero(F.avg(F.when(done, F.col(duration)))).alias("avg_duration_ms"))


def trends(log: DataFrame, at: str, metrics: Sequence[str], granularity: str = "day") -> DataFrame:
    """Per hour or day (anything else is a day): count and average of each metric, in time order."""
    bucket = _bucket(log, at, "hour" if granularity == "hour" else "day")
    return log.groupBy(bucket).agg(F.count("*").alias("row_count"), *[F.avg(m).alias(f"avg_{m}") for m in metrics]).orderBy("bucket")


def usage_summary(log: DataFrame, at: str, sums: Sequence[str], averages: Sequence[str]) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return log.agg(
        F.count("*").alias("row_count"), *[zero(F.sum(c)).alias(f"sum_{c}") for c in sums], *[zero(F.avg(c)).alias(f"avg_{c}") for c in averages],
        F.min(at).alias("period_start"), F.max(at).alias("period_end"),
    )


def usage_by_time(log: DataFrame, at: str, sums: Sequence[str], granularity: str = "hour") -> DataFrame:
    bucket = _bucket(log, at, "day" if granularity == "day" else "hour")
    return log.groupBy(bucket).agg(F.count("*").alias("row_count"), *[F.sum(c).alias(f"sum_{c}") for c in sums]).orderBy("bucket")


def distribution(log: DataFrame, by: str, value: str, unknown: str | None = None) -> DataFrame:
    """Count, sum and average per key, largest sum first; the null key is named only after grouping."""
    out = log.groupBy(by).agg(F.count("*").alias("row_count"), F.sum(value).alias(f"sum_{value}"), F.avg(value).alias(f"avg_{value}"))
    return (out.withColumn(by, F.coalesce(by, F.lit(unknown))) if unknown else out).orderBy(F.desc_nulls_first(f"sum_{value}"), by)


def distinct_values(log: DataFrame, column: str) -> DataFrame:
    return log.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def alerts(log: DataFrame, thresholds: Mapping[str, float], at: str, key: str, limit: int | None = 50, status: str = "status") -> DataFrame:
    """Completed rows under any threshold, newest first, with the names of the metrics under theirs."""
    under = {m: F.coalesce(F.col(m) < t, F.lit(False)) for m, t in thresholds.items()}
    hit = F.array_compact(F.array(*[F.when(test, F.lit(m)) for m, test in under.items()]))
    out = log.where(F.col(status) == "completed").withColumn("violated", hit).where(F.size("violated") > 0).orderBy(F.desc(at), F.asc(key))
    return out if limit is None else out.limit(limit)
