"""Gates that a source's rows or links must pass, and how its failures are treated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_policy(sources: DataFrame, policies: DataFrame, key: str, least_hosts: int = 1, most_share: float = 1.0) -> DataFrame:
    """``sources`` with least_hosts and most_share: of the configured policy, else the permissive ones."""
    joined = sources.join(policies.select(key, "least_hosts", "most_share"), key, "left")
    return joined.withColumns({"least_hosts": F.coalesce("least_hosts", F.lit(least_hosts)), "most_share": F.coalesce("most_share", F.lit(most_share))})


def quality_report(listings: DataFrame, source: str, host: str, is_open: Column) -> DataFrame:
    """For each source its rows, open rows, hosts and the largest share of one host. Two counts, no window."""
    hosts = listings.groupBy(source, host).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("open"))
    sums = hosts.groupBy(source).agg(F.sum("n").alias("n_rows"), F.sum("open").alias("n_open"), F.count(F.lit(1)).alias("n_hosts"), F.max("n").alias("largest"))
    return sums.withColumn("share", F.col("largest") / F.col("n_rows")).drop("largest")


def quality_failures(rows: Column, before: Column, hosts: Column, share: Column, least_hosts: Column, most_share: Column, dormant: Column) -> Column:
    """The names of the rules that a source breaks: no rows where there were some (not for dormant
    sources), too few hosts, one host too common."""
    broken = (
        F.when((rows == 0) & (before > 0) & ~dormant, F.lit("zero-rows")),
        F.when((rows > 0) & (hosts < least_hosts), F.lit("few-hosts")),
        F.when((rows > 0) & (share > most_share), F.lit("one-host")),
    )
    return F.array_compact(F.array(*broken))


def link_gate(checks: DataFrame, group: str, failed: Column, outage: Column, most: float = 0.2) -> DataFrame:
    """For each group the links checked, failed and out of reach for a while, and whether failures pass ``most``."""
    out = checks.groupBy(group).agg(F.count_if(~outage).alias("checked"), F.count_if(failed & ~outage).alias("failures"), F.count_if(outage).alias("outages"))
    return out.withColumn("blocked", F.col("failures") > most * F.col("checked"))


def retryable(category: Column, status: Column) -> Column:
    """Transport errors, 429 and server errors are tried again."""
    return F.coalesce((category == "transport") | (status == 429) | status.between(500, 599), F.lit(False))


def quarantined(category: Column, status: Column, failures: Column) -> Column:
    """Broken payloads, and boards that refuse or are missing, at once; quality, link and empty failures at the
    second. A failure without a category does not quarantine."""
    at_once = category.isin("json", "identity") | ((category == "http") & status.isin(401, 403, 404))
    return F.coalesce(at_once, F.lit(False)) | F.coalesce(category.isin("quality", "link", "empty") & (failures >= 2), F.lit(False))


def spans(sightings: DataFrame, key: str, seconds: Column, least: int = 24 * 3600) -> DataFrame:
    """For each key whether its sightings lie at least ``least`` seconds apart."""
    return sightings.groupBy(key).agg((F.max(seconds) - F.min(seconds) >= least).alias("spanned"))


def state_for(is_quarantined: Column, succeeded_at: Column, stored: Column, age_minutes: Column, active: Column) -> Column:
    """Quarantined; without any success the stored state or never-succeeded; degraded if stored so or older
    than 90 minutes (active) or 7 hours (quiet or empty); else healthy."""
    late = age_minutes > F.when(active, 90).otherwise(420)
    return (
        F.when(is_quarantined, "quarantined")
        .when(succeeded_at.isNull(), F.coalesce(stored, F.lit("never-succeeded")))
        .when(F.coalesce(stored == "degraded", F.lit(False)) | late, "degraded")
        .otherwise("healthy")
    )


def state_rank(state: Column) -> Column:
    """Quarantined first, then degraded, never-succeeded and healthy: the order of a reliability report."""
    return F.when(state == "quarantined", 0).when(state == "degraded", 1).when(state == "never-succeeded", 2).otherwise(3)
