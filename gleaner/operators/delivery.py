"""Delivery of alerts: caps of a run, receipts with their tickets, retries and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Alerts of a run for one device, those sent one by one, and the attempts that a receipt has.
CAP, SINGLE, ATTEMPTS = 10, 5, 3


def alert_buckets(alerts: DataFrame, device: str, order: list[Column]) -> DataFrame:
    """The first ``CAP`` alerts of each device with ``bucket``: single for the first ``SINGLE``, then chunk."""
    nth = F.row_number().over(Window.partitionBy(device).orderBy(*order))
    ranked = alerts.withColumn("nth", nth).where(F.col("nth") <= CAP)  # Spark stops early within a partition
    return ranked.withColumn("bucket", F.when(F.col("nth") <= SINGLE, "single").otherwise("chunk"))


def retry_outcome(attempts: Column, *sides: Column) -> Column:
    """``retry`` while job, preference and device are all there and attempts are left, else ``error``."""
    missing = F.lit(False)
    for side in sides:
        missing = missing | side.isNull()
    return F.when(missing | (attempts >= ATTEMPTS), "error").otherwise("retry")


def settle(receipts: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Pending receipts with ``status`` after their tickets' results, and whether the device goes.

    Without a ticket a receipt stays pending; an unregistered device is an error and is deactivated;
    other failures are tried again until ``ATTEMPTS`` were made. A receipt that counts none was tried once.
    """
    result = F.col("result")
    status = F.when(result.isNull(), "pending").when(result == "ok", "ok").when((result == "DeviceNotRegistered") | (F.coalesce("attempts", F.lit(1)) >= ATTEMPTS), "error").otherwise("retryable")
    joined = receipts.join(tickets.select(key, "result"), key, "left")
    return joined.withColumns({"status": status, "deactivated": F.coalesce(result == "DeviceNotRegistered", F.lit(False))}).drop("result")


def marked(df: DataFrame, flag: str, sent: DataFrame, key: str) -> DataFrame:
    """``df`` with ``flag`` taken from the rows whose key was sent."""
    done = sent.select(F.col(key).alias("_key")).distinct().withColumn("_sent", F.lit(True))
    return df.join(done, F.col(key) == F.col("_key"), "left").withColumn(flag, F.col(flag) & F.col("_sent").isNull()).drop("_key", "_sent")
