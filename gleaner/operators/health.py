"""Health of sources from their run log: streaks, rates, states, backoff and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def success_rate(runs: DataFrame, source: str, failed: Column) -> DataFrame:
    return runs.groupBy(source).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~failed).alias("succeeded")).withColumn("success_rate", F.col("succeeded") / F.col("runs"))


def with_streak(df: DataFrame, group: list[str], order: list[str], counts: Column, name: str = "streak") -> DataFrame:
    """``df`` with the number of rows since the last one for which ``counts`` is false (gaps and islands)."""
    by = Window.partitionBy(*group).orderBy(*order)
    island = F.sum(F.when(counts, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_island", island).withColumn(name, F.sum(F.when(counts, 1).otherwise(0)).over(inside)).drop("_island")


def newest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def backoff_seconds(failures: Column, retry_after: Column | None = None, first: int = 60, most: int = 1800) -> Column:
    """Doubling waits, at least what the source asks for, at most ``most``; 0 without failures."""
    wait = F.lit(first) * F.pow(F.lit(2), F.least(failures, F.lit(20)) - 1)
    asked = F.coalesce(retry_after, F.lit(0)) if retry_after is not None else F.lit(0)
    return F.when(failures > 0, F.least(F.lit(most), F.greatest(wait, asked))).otherwise(0).cast("long")


def epoch_seconds(at: str) -> Column:
    """Whole seconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({at} as timestamp_ntz))")


def poll_window(seconds: Column, minutes: int = 30) -> Column:
    """The number of the window of the epoch that a time (in seconds) falls in."""
    return F.floor(seconds / (60 * minutes))


def blocked_suffix(df: DataFrame, group: list[str], order: list[str], failed: Column) -> DataFrame:
    """Rows of each ordered group at or after its first failure."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_failures", F.sum(F.when(failed, 1).otherwise(0)).over(upto)).where("_failures > 0").drop("_failures")


def due(status: Column, paused: Column, backoff_until: Column, last_at: Column, bucket: Column, now: Column, minutes: int = 30, shadow_windows: int = 6) -> Column:
    """Whether a source is polled now: never while paused or backing off, each window once published,
    else every ``shadow_windows`` windows; one that never ran waits for its bucket's window. Times are in seconds."""
    window = poll_window(now, minutes)
    rest = F.when(last_at.isNotNull(), window - poll_window(last_at, minutes) >= shadow_windows).otherwise(window % shadow_windows == bucket)
    return F.when(paused | F.coalesce(backoff_until > now, F.lit(False)), False).when(status == "published", True).otherwise(rest)
