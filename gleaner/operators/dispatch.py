"""Which sources run now, which jobs are written with an alert, and what a month's checks still ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.hashing import fnv_bucket
from gleaner.operators.health import due

#: Windows of half an hour over which shadow sources are spread.
WINDOWS = 6
#: Rows that one task sorts, about: what a task holds must not grow with the tables.
TASK_ROWS = 1_000_000


def due_sources(sources: DataFrame, checkpoints: DataFrame, health: DataFrame, now: int) -> DataFrame:
    """The rows of ``sources`` (source_id, status, ...) that are polled at ``now`` (seconds).

    ``checkpoints`` is (source_id, last_success_at), a shadow source's under ``shadow-<id>``; ``health`` (source_id, paused,
    backoff_until, last_attempt_at, last_success_at). A shadow source counts from its last attempt, else success, else
    checkpoint; with a row but no time it runs at once, without any in its bucket's window.
    """
    c = F.col
    kept = checkpoints.select(c("source_id").alias("_checkpoint"), c("last_success_at").alias("_kept"))
    lived = health.select(c("source_id").alias("_health"), "paused", "backoff_until", "last_attempt_at", c("last_success_at").alias("_lived"))
    name = F.concat(F.when(c("status") == "shadow", "shadow-").otherwise(""), "source_id")
    both = sources.join(kept, name == c("_checkpoint"), "left").join(lived, c("source_id") == c("_health"), "left")
    last = F.coalesce("last_attempt_at", "_lived", "_kept")
    known = (c("_checkpoint").isNotNull() | c("_health").isNotNull()) & last.isNull()
    # A source with state but no time counts as polled long ago.
    at = F.when(known, F.lit(0).cast("long")).otherwise(last)
    runs = due(c("status"), F.coalesce("paused", F.lit(False)), c("backoff_until"), at, fnv_bucket(c("source_id"), WINDOWS), F.lit(now), shadow_windows=WINDOWS)
    return both.where(runs).select(*sources.columns)


def split_writes(jobs: DataFrame, notifications: DataFrame, key: str, event: str = "event_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quiet, alerting, orphaned): jobs without a notification, jobs each with its last notification by ``event``, notifications without a job.

    Rows are counted first, and both tables dealt by key once over so many tasks that each has about ``TASK_ROWS``.
    """
    tasks = max(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(jobs.count() + notifications.count()) // TASK_ROWS))
    jobs, notifications = jobs.repartition(tasks, key), notifications.repartition(tasks, key)
    last = notifications.groupBy(key).agg(F.max_by(F.struct(*(c for c in notifications.columns if c != key)), event).alias("notification"))
    merged = lambda df: df.hint("merge")
    return jobs.join(merged(notifications.select(key)), key, "left_anti"), jobs.join(merged(last), key), notifications.join(merged(jobs.select(key)), key, "left_anti")


def checklists(items: DataFrame, completions: DataFrame, period: str = "period", item: str = "item") -> DataFrame:
    """(period, completed, total, complete, pending) of every period with a completion. ``items`` is (item, position), a few rows; what
    is not an item does not count, an item that was completed twice counts once. pending: items in order."""
    # A struct of a handful of items goes with every period, so no period is paired with item rows.
    wanted = items.agg(F.array_sort(F.collect_list(F.struct("position", F.col(item).alias("item")))).alias("_items"))
    done = completions.groupBy(period).agg(F.collect_set(item).alias("_done"))  # at most an entry an item, for few hold others
    both = done.join(F.broadcast(wanted), F.lit(True))
    names = F.transform("_items", lambda x: x["item"])
    left = F.array_except(names, "_done")
    return both.select(period, (F.size(names) - F.size(left)).alias("completed"), F.size(names).alias("total"), (F.size(left) == 0).alias("complete"), left.alias("pending"))


def attention(dead_letters: Column, failed: Column, stale: Column, quarantined: Column, alarms: Column, legacy: Column) -> Column:
    """How many signals ask for a look: sums, and one for any legacy alerts that wait."""
    n = lambda x: F.coalesce(x, F.lit(0))
    return n(dead_letters) + n(failed) + n(stale) + n(quarantined) + n(alarms) + F.when(n(legacy) > 0, 1).otherwise(0)


def reminder(pending: Column, signals: Column) -> Column:
    """A reminder's subject, null where nothing is pending."""
    some = F.size(pending)
    tail = F.when(signals > 0, F.concat(F.lit(" · "), signals.cast("string"), F.lit(" signals need review"))).otherwise("")
    return F.when(some > 0, F.concat(some.cast("string"), F.lit(" monitoring checks pending"), tail))
