"""Rules that the evidence for publishing a source must keep, as tables of name and condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Clean snapshots and seconds that they span, the share of links that may fail, and seconds that clocks may differ.
SNAPSHOTS, SPAN, LINK_FAILURES, SKEW = 3, 24 * 3600, 0.2, 300
SNAPSHOT = "source_id string, run_id string, completed_at long, succeeded boolean, complete boolean, identity_verified boolean, schema_valid boolean, raw_rows long, eligible_rows long, withheld_rows long, links_checked long, link_failures long"
PROMOTION = "source_id string, approved_by string, approved_at long, quiet_baseline boolean, stable_identity boolean, stable_hosts boolean, override_reason string, override_until long"


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of evidence folders (``<folder>/<name>.json``) with folder and file; a malformed one fails the read."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.input_file_name()
    return docs.withColumns({"folder": F.regexp_extract(name, r"([^/]+)/[^/]+$", 1), "file": F.regexp_extract(name, r"([^/]+)$", 1)})


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds, in order; an unknown one does not."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def snapshot_rules() -> dict[str, Column]:
    c = F.col
    counts = ("raw_rows", "eligible_rows", "withheld_rows", "links_checked", "link_failures")
    bad = F.lit(False)
    for n in counts:
        bad = bad | c(n).isNull() | (c(n) < 0)
    return {
        "not-succeeded": ~c("succeeded"), "not-complete": ~c("complete"), "identity-unverified": ~c("identity_verified"), "schema-invalid": ~c("schema_valid"),
        "more-rows-than-raw": c("eligible_rows") + c("withheld_rows") > c("raw_rows"), "links-not-checked-once": c("links_checked") != c("eligible_rows"),
        "more-failures-than-links": c("link_failures") > c("links_checked"), "link-failure-rate": (c("links_checked") > 0) & (c("link_failures") > LINK_FAILURES * c("links_checked")), "counts-invalid": bad,
    }


def promotion_rules(now: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Rules of every promotion, and those of promotions with enough snapshots."""
    c = F.col
    has = c("override_until").isNotNull() | c("override_reason").isNotNull()
    blank = lambda n: F.trim(F.coalesce(c(n), F.lit(""))) == ""
    early = c("override_until") <= c("approved_at")
    active = has & c("override_until").isNotNull() & ~F.coalesce(early, F.lit(False)) & (c("override_until") > now)
    active = F.coalesce(active, F.lit(False))
    least = F.when(active, 1).otherwise(SNAPSHOTS)
    first = {
        "no-approver": blank("approved_by"), "approval-time-invalid": c("approved_at").isNull(), "approved-in-future": c("approved_at") > now + SKEW,
        "baseline-not-approved": ~F.coalesce("quiet_baseline", F.lit(False)), "identity-not-stable": ~F.coalesce("stable_identity", F.lit(False)), "hosts-not-stable": ~F.coalesce("stable_hosts", F.lit(False)),
        "override-without-reason": has & blank("override_reason"), "override-time-invalid": has & c("override_until").isNull(), "override-before-approval": has & early, "override-overdue": has & ~F.coalesce(early, F.lit(False)) & (c("override_until") <= now),
        "too-few-snapshots": c("n") < least,
    }
    known = c("n_times") == c("n")
    rest = {
        "snapshot-time-invalid": ~known, "span-too-short": known & ~active & (c("last") - c("first") < SPAN), "snapshot-in-future": known & (c("last") > now + SKEW),
        "approved-before-snapshot": known & (c("approved_at") < c("last")), "runs-not-unique": c("n_runs") < c("n"),
    }
    return first, rest


def promotion_violations(sources: DataFrame, promotions: DataFrame, snapshots: DataFrame, now: int) -> DataFrame:
    """(source_id, violations) of every source: none for one that is not published, else what its evidence breaks.

    Snapshots count by partial aggregates; only broken rules travel, as ``run: rule``, after those of the promotion.
    A promotion with too few snapshots is not looked at further.
    """
    told = snapshots.withColumn("_broken", F.transform(broken(snapshot_rules()), lambda r: F.concat(F.coalesce("run_id", F.lit("?")), F.lit(": "), r)))
    sums = told.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("n_times"), F.count_distinct("run_id").alias("n_runs"), F.min("completed_at").alias("first"), F.max("completed_at").alias("last"),
        F.array_sort(F.flatten(F.collect_list("_broken"))).alias("told"),
    )
    joined = sources.join(promotions.withColumn("_given", F.lit(True)), "source_id", "left").join(sums, "source_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n", "n_times", "n_runs")})
    first, rest = promotion_rules(now)
    head = broken(first)
    whole = F.when(F.array_contains(head, "too-few-snapshots"), head).otherwise(F.concat(head, broken(rest), F.coalesce("told", F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    found = F.when(F.col("status") != "published", none).when(F.col("_given").isNull(), F.array(F.lit("no-evidence"))).otherwise(whole)
    return joined.select("source_id", found.alias("violations"))
