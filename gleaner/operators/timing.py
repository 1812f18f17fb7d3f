"""When a job was posted, by what vouches for it: the employer, a source, or the catalog's own first sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.times import absolute_time, compact_age, posting_date

OFFICIAL = "(?i)^(?:ashby|greenhouse|lever)-"


def posting_timing(jobs: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, kind, timestamp) of each job: ``employer-posted``, ``source-reported``, ``found`` or ``unknown``.

    ``jobs`` is (key, first_seen_at), ``references`` (key, source_id, posted_at, provider_time, semantics), times as text. A provider's time counts
    if it means publication; the posted time of a source that is no provider counts where no provider's time is given. Official times go before
    others, then the first as text; a time that is no absolute one counts nowhere. One partial aggregate, no list of a job's references.
    """
    c = F.col
    official, published = c("source_id").rlike(OFFICIAL), F.coalesce(c("semantics") == "published", F.lit(False))
    value = F.when(published, c("provider_time")).when(c("provider_time").isNull() & ~official, c("posted_at"))
    candidates = references.select(key, (~(published & official)).alias("_late"), absolute_time(value).alias("_time")).where("_time is not null")
    first = candidates.groupBy(key).agg(F.min(F.struct("_late", "_time")).alias("_first"))
    found = absolute_time(c("first_seen_at"))
    kind = F.when(~c("_first._late"), "employer-posted").when(c("_first").isNotNull(), "source-reported").when(found.isNotNull(), "found").otherwise("unknown")
    return jobs.join(first, key, "left").select(key, kind.alias("kind"), F.coalesce("_first._time", found).alias("timestamp"))


def timing_text(kind: Column, timestamp: Column, first_seen_at: Column, now: Column, finder: str) -> Column:
    """(summary, detail) of a job's time for a reader; ``finder`` is the catalog's name, ``now`` in seconds."""
    at, found = F.try_to_timestamp(timestamp), F.try_to_timestamp(absolute_time(first_seen_at))
    age = lambda t: compact_age(now - F.unix_timestamp(t), t)
    official = kind == "employer-posted"
    label = F.when(official, "Employer posted ").otherwise("Source reported ")
    seen = F.coalesce(F.concat(F.lit(f" · Found by {finder} "), posting_date(found)), F.lit(""))
    vouched = F.when(official, " · Verified employer date").otherwise(" · Not employer-verified")
    posted = kind.isin("employer-posted", "source-reported")
    summary = F.when(posted, F.concat(label, age(at))).when(kind == "found", F.concat(F.lit(f"Found by {finder} "), age(found))).otherwise("Posting time unavailable")
    detail = F.when(posted, F.concat(label, posting_date(at), vouched, seen)).otherwise(F.concat(F.lit("Original posting date unavailable"), seen))
    return F.struct(summary.alias("summary"), detail.alias("detail"))


def source_text(references: DataFrame, key: str) -> DataFrame:
    """(key, primary, corroboration): which providers vouch for a job, in the order of its references (``position``), and whether a community list does too.

    Sightings count by (job, provider) first, so a job of very many references sends on three rows at most.
    """
    c = F.col
    name = F.initcap(F.regexp_extract(F.lower("source_id"), OFFICIAL.replace("(?:", "("), 1))
    community = c("source_id").rlike("(?i)^github-") | F.coalesce(c("source_url").rlike(r"(?i)(?:^|//)(?:raw\.)?github(?:usercontent)?\.com(?:[/:]|$)"), F.lit(False))
    by = references.groupBy(key, name.alias("_name")).agg(F.min("position").alias("_at"), F.bool_or(community).alias("_community"))
    sums = by.groupBy(key).agg(F.array_sort(F.collect_list(F.when(c("_name") != "", F.struct("_at", "_name")))).alias("_official"), F.bool_or("_community").alias("_community"))
    official = F.transform("_official", lambda x: x["_name"])
    both = F.when((F.size(official) > 0) & c("_community"), "Also corroborated by a community listing")
    primary = F.when(F.size(official) > 0, F.concat(F.lit("Official employer source · "), F.array_join(official, " + "))).otherwise("Community listing")
    return sums.select(key, primary.alias("primary"), both.alias("corroboration"))
