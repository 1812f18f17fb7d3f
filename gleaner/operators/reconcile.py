"""What a complete snapshot changes: presence and omission of a source's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Snapshots without an item after which it closes.
CLOSE_AFTER = 2


def reconcile(prior: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """The next occurrences: ``prior`` has keys, present, omissions and open; ``snapshot`` has keys.

    ``change`` tells new, present, returned, omitted or closed; an item that was closed and is still
    missing keeps its state and is ``unchanged``.
    """
    now = snapshot.select(*keys).distinct().withColumn("_here", F.lit(True))
    both = prior.withColumn("_known", F.lit(True)).join(now, keys, "full_outer")
    here, known = F.coalesce("_here", F.lit(False)), F.coalesce("_known", F.lit(False))
    omissions = F.when(here, 0).otherwise(F.coalesce("omissions", F.lit(0)) + 1)
    change = F.when(here & ~known, "new").when(here & F.col("present"), "present").when(here, "returned").when(~F.col("open"), "unchanged").when(omissions >= CLOSE_AFTER, "closed").otherwise("omitted")
    next_omissions = F.when(change == "unchanged", F.col("omissions")).otherwise(omissions).cast("int")
    return both.select(*keys, here.alias("present"), next_omissions.alias("omissions"), F.when(here, True).otherwise(F.col("open") & (omissions < CLOSE_AFTER)).alias("open"), change.alias("change"))


def changed(after: DataFrame) -> DataFrame:
    """Only what must be written."""
    return after.where(~F.col("change").isin("present", "unchanged"))


def outbox(events: DataFrame, sent: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that were not sent; equal ones once, so that a replay adds nothing."""
    return events.dropDuplicates([key]).join(sent.select(key), key, "left_anti")


def first_seen(now: DataFrame, prior: DataFrame, key: str, at: str) -> DataFrame:
    """``now`` with first_observed_at, which never changes once known, and its precision.

    A key that the prior rows have without a time keeps none, with the precision unknown.
    """
    before = prior.select(F.col(key).alias("_key"), F.col("first_observed_at").alias("_first"), F.lit(True).alias("_known"))
    joined = now.join(before, F.col(key) == F.col("_key"), "left")
    known = F.col("_known").isNotNull()
    first = F.when(known, F.col("_first")).otherwise(F.col(at))
    precision = F.when(known & F.col("_first").isNull(), "unknown").otherwise("exact")
    return joined.withColumns({"first_observed_at": first, "precision": precision}).drop("_key", "_first", "_known")


def alerts(created: DataFrame, source: str, trusted: DataFrame, wanted) -> DataFrame:
    """New rows with ``recency`` and ``alert``: rows of a source without a trusted snapshot before are its
    quiet baseline and never alert; others alert if they are wanted."""
    known = trusted.select(F.col(source).alias("_source")).distinct()
    joined = created.join(known, F.col(source) == F.col("_source"), "left")
    baseline = F.col("_source").isNull()
    return joined.withColumns({"recency": F.when(baseline, "baseline").otherwise("normal"), "alert": ~baseline & wanted}).drop("_source")


def unchanged(snapshots: DataFrame, source: str, order: str, content: str) -> DataFrame:
    """``snapshots`` with whether the content hash is that of the source's snapshot before."""
    before = F.lag(content).over(Window.partitionBy(source).orderBy(order))
    return snapshots.withColumn("unchanged", F.col(content).eqNullSafe(before) & before.isNotNull())
