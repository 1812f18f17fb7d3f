"""Sightings of postings at sources: when they were last confirmed, which ones a job rests on, and their seeding from references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.url import normalize_url

#: Sources whose references name a posting by what they hold as document.
BY_DOCUMENT = "^(?:shadow-)?(?:lever|greenhouse)-"


def confirmed(occurrences: DataFrame, checkpoints: DataFrame, active: DataFrame, health: DataFrame) -> DataFrame:
    """``occurrences`` (source_id, external_id, ...) with confirmed_hash and confirmed_at.

    ``checkpoints`` is (source_id, content_hash, last_success_at), ``active`` (source_id, external_id) of what each source's
    last snapshot holds, ``health`` (source_id, last_success_at). Only what is active is confirmed, at the success that health
    tells, else the checkpoint. Active ids are rows of a join, not a list of the source's, so a source of a third of all rows
    spreads by its ids.
    """
    c = F.col
    shown = active.select("source_id", "external_id").distinct().withColumn("_shown", F.lit(True))
    marks = checkpoints.select("source_id", c("content_hash").alias("_hash"), c("last_success_at").alias("_at"))
    lived = health.select("source_id", c("last_success_at").alias("_lived"))
    both = occurrences.join(shown, ["source_id", "external_id"], "left").join(marks, "source_id", "left").join(lived, "source_id", "left")
    out = both.withColumns({"confirmed_hash": F.when(c("_shown"), c("_hash")), "confirmed_at": F.when(c("_shown"), F.coalesce("_lived", "_at"))})
    return out.select(*occurrences.columns, "confirmed_hash", "confirmed_at")


def attributed(references: DataFrame, occurrences: DataFrame, direct: DataFrame) -> DataFrame:
    """``references`` (job, source_id, external_id, document, row) with source_kind and its sighting's first_observed_at, precision and confirmed_at.

    A sighting is found by its external id, else by (document, row), of several the smallest external id; ``direct`` names the
    sources that are providers' own. Nulls match nothing by id; by document and row they match one another.
    """
    c = F.col
    facts = F.struct("external_id", "first_observed_at", "precision", "confirmed_at")
    by_id = occurrences.where("external_id is not null").groupBy("source_id", "external_id").agg(F.min(facts).alias("_by_id"))
    by_row = occurrences.groupBy(c("source_id").alias("_source"), c("document").alias("_document"), c("row").alias("_row")).agg(F.min(facts).alias("_by_row"))
    own = direct.select("source_id").distinct().withColumn("_direct", F.lit(True))
    on = (c("source_id") == c("_source")) & c("document").eqNullSafe(c("_document")) & c("row").eqNullSafe(c("_row"))
    both = references.join(by_id, ["source_id", "external_id"], "left").join(by_row, on, "left").join(own, "source_id", "left")
    found = F.coalesce("_by_id", "_by_row")
    return both.select(
        *references.columns, F.when(c("_direct"), "direct-provider").otherwise("aggregator").alias("source_kind"), found["first_observed_at"].alias("first_observed_at"),
        F.coalesce(found["precision"], F.lit("unknown")).alias("precision"), found["confirmed_at"].alias("confirmed_at"),
    )


def attribution_lag(sightings: DataFrame) -> DataFrame:
    """(job, provider_first, aggregator_first, lag) of what :func:`attributed` gives: first exact times by kind, and provider minus aggregator."""
    exact = F.when(F.col("precision") == "exact", F.col("first_observed_at"))
    first = lambda kind: F.min(F.when(F.col("source_kind") == kind, exact))
    out = sightings.groupBy("job").agg(first("direct-provider").alias("provider_first"), first("aggregator").alias("aggregator_first"))
    return out.withColumn("lag", F.col("provider_first") - F.col("aggregator_first"))


def derived_id(source: Column, external: Column, document: Column, url: Column) -> Column:
    """A reference's external id: its own, else what its connector would give: the document, or document and normalized address; null if neither."""
    given = lambda x: F.when(x != "", x)
    return F.coalesce(given(external), F.when(source.rlike(BY_DOCUMENT), given(document)).otherwise(F.concat(given(document), F.lit(":"), normalize_url(url))))


def seed_occurrences(references: DataFrame, occurrences: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a seeding from the catalog's references writes, and its counts by source.

    ``references`` is (job, position, source_id, external_id, document, apply_url). A sighting that is there already is
    skipped, of several references of one the first job's first counts, the others are skipped. Seeded sightings are present
    without omissions, with the checkpoint's hash or ``backfill``, and tell no time of discovery. Counts: seeded, skipped, unidentifiable.
    """
    c = F.col
    named = references.withColumn("_id", derived_id(c("source_id"), c("external_id"), c("document"), c("apply_url")))
    there = occurrences.select("source_id", c("external_id").alias("_id")).distinct()
    first = named.where("_id is not null").groupBy("source_id", "_id").agg(F.min(F.struct("job", "position")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    marked = first.join(there.withColumn("_there", F.lit(True)), ["source_id", "_id"], "left")
    fresh = marked.where("_there is null").join(checkpoints.select("source_id", "content_hash"), "source_id", "left")
    seeds = fresh.select(
        "source_id", c("_id").alias("external_id"), c("_first.job").alias("job"), F.lit(True).alias("present"), F.lit(0).alias("omissions"),
        F.coalesce("content_hash", F.lit("backfill")).alias("changed_hash"), F.lit("unknown").alias("precision"),
    )
    lost = named.where("_id is null").groupBy("source_id").agg(F.count(F.lit(1)).alias("unidentifiable"))
    done = marked.groupBy("source_id").agg(F.count_if(c("_there").isNull()).alias("seeded"), F.sum(c("_n") - F.when(c("_there").isNull(), 1).otherwise(0)).alias("skipped"))
    counts = done.join(lost, "source_id", "full")
    return seeds, counts.select("source_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("seeded", "skipped", "unidentifiable")))
