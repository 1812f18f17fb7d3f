"""The same reconciliation as a stream of complete snapshots, and an outbox that a replay leaves alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.reconcile import CLOSE_AFTER, outbox

#: A row for each item, and one without an item for each source.
FOLDED = "source_id string, external_id string, present boolean, omissions int, open boolean, number long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v="))


def occurrences(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest complete version of the table, or the newest before a version."""
    return folded(spark, path, before).where("external_id is not null").drop("number")


def folded(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest complete version with the number of each source's last snapshot, also for sources without items."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(FOLDED).parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], FOLDED)


def fold_snapshots(prior: DataFrame, batch: DataFrame) -> DataFrame:
    """``prior`` (as :func:`folded` gives it) after the snapshots (source_id, number, external_id) of ``batch``, in order of their numbers.

    A null external_id says that there was a snapshot, be it an empty one. Snapshots up to the number
    that a source has seen are skipped, so folding anything twice changes nothing. Order needs no loop:
    of an item only its last snapshot counts and how many of its source's snapshots came after it. The
    numbers of a batch's snapshots are few; items meet by partial maxima, so no source is gathered.
    """
    seen = prior.groupBy("source_id").agg(F.max("number").alias("_upto"))
    fresh = batch.join(seen, "source_id", "left").where("_upto is null or number > _upto")
    numbers = fresh.groupBy("source_id").agg(F.collect_set("number").alias("_numbers"))
    here = fresh.where("external_id is not null").groupBy("source_id", "external_id").agg(F.max("number").alias("_at"))
    items = prior.where("external_id is not null").drop("number").withColumn("_known", F.lit(True))
    both = items.join(here, ["source_id", "external_id"], "full_outer").join(numbers, "source_id", "left").join(seen, "source_id", "left")
    after = F.coalesce(F.size(F.filter("_numbers", lambda n: F.col("_at").isNull() | (n > F.col("_at")))), F.lit(0))
    back = F.col("_at").isNotNull()
    missed = F.when(back, after).otherwise(F.col("omissions") + after)
    last = F.coalesce(F.array_max("_numbers"), "_upto")
    rows = both.select(
        "source_id",
        "external_id",
        F.when(back | (after > 0), back & (after == 0)).otherwise(F.col("present")).alias("present"),
        F.least(missed, F.lit(CLOSE_AFTER)).cast("int").alias("omissions"),
        F.when(back, after < CLOSE_AFTER).otherwise(F.col("open") & (missed < CLOSE_AFTER)).alias("open"),
        last.alias("number"),
    )
    marks = seen.join(numbers, "source_id", "full_outer").select("source_id", *(F.lit(None).cast(t).alias(n) for n, t in (("external_id", "string"), ("present", "boolean"), ("omissions", "int"), ("open", "boolean"))), last.alias("number"))
    return rows.unionByName(marks)


def apply_snapshots(batch: DataFrame, path: str) -> None:
    """Write the next version of the table at ``path``; the two before it stay for readers, older ones go.

    The snapshots' own numbers decide what is new, not the stream's batches: a batch done again, or a
    fresh checkpoint over the same feed, writes the same rows.
    """
    spark = batch.sparkSession
    done = _versions(spark, path)
    at = done[-1] + 1 if done else 0
    fold_snapshots(folded(spark, path), batch).write.mode("overwrite").parquet(f"{path}/v={at}")
    for old in done[:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def follow(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of snapshots (source_id, number, external_id; a null id for an empty one), all that is there, then stop.

    The table is written before the stream notes a batch as done, so a failure in between repeats it.
    """
    return snapshots.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, i: apply_snapshots(b, path)).start()


def send_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events that are not in the outbox table yet, whatever checkpoint or batch they come by."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _versions(spark, path)
        paths = [f"{path}/v={v}" for v in known]
        sent = spark.read.schema(batch.schema).parquet(*paths) if paths else spark.createDataFrame([], batch.schema)
        outbox(batch, sent).write.mode("overwrite").parquet(f"{path}/v={known[-1] + 1 if known else 0}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def sent_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    paths = [f"{path}/v={v}" for v in _versions(spark, path)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def window_counts(runs: DataFrame, at: str = "ts", key: str = "source_id", minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Runs of each source in tumbling windows, with a watermark."""
    return runs.withWatermark(at, late).groupBy(F.window(at, f"{minutes} minutes").alias("w"), key).agg(F.count(F.lit(1)).alias("runs")).select(key, F.col("w.start").alias("window_start"), "runs")
