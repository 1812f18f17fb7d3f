"""Users' applications with their jobs, how far a form can be helped with, and the digest of pending jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.url import host, host_allowed
from gleaner.operators.attribution import ASHBY_HOST, GREENHOUSE_HOSTS, LEVER_HOST, path_of
from gleaner.operators.messages import escape_html

#: Statuses of an application.
STATUSES = ("saved", "applied", "assessment", "interview", "offer", "rejected", "withdrawn")
_HEX = "[0-9a-fA-F]"
_ASHBY_FORM = rf"^(?i:https://{ASHBY_HOST})(?::443)?/([^/?#]+)/{_HEX}{{8}}-{_HEX}{{4}}-[1-8]{_HEX}{{3}}-[89aAbB]{_HEX}{{3}}-{_HEX}{{12}}/application(?:[?#].*)?$"
#: What a reader of applications sees of a job.
JOB = ("company", "title", "location", "season", "apply_url", "open")


def greenhouse_form(url: Column) -> Column:
    return host_allowed(host(url), list(GREENHOUSE_HOSTS)) | (host(url) == "job-boards.eu.greenhouse.io")


def lever_form(url: Column) -> Column:
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    return (host(url) == LEVER_HOST) & (F.size(parts) == 3) & (F.lower(F.get(parts, F.lit(2))) == "apply")


def ashby_form(url: Column) -> Column:
    """The board of an address that is just a posting's form, its case kept; null for others."""
    return F.nullif(F.regexp_extract(F.trim(url), _ASHBY_FORM, 1), F.lit(""))


def assistance(url: Column, mode: Column, ashby_published: Column) -> Column:
    """(eligibility, reason, action) of an address; what was not reviewed is manual. ``ashby_published``: whether its board, as
    :func:`ashby_form` names it, is a published one."""
    by = lambda eligibility, reason, action="open-official-form": F.struct(F.lit(eligibility).alias("eligibility"), F.lit(reason).alias("reason"), F.lit(action).alias("action"))
    headed = lambda name: by("headed-supported", f"{name}-headed-pilot", "assist-in-safari")
    return (
        F.when(mode == "partner", by("partner-only", "partner-submission-requires-employer-authorization")).when(host_allowed(host(url), ["linkedin.com"]), by("manual-only", "destination-policy-prohibits-automation"))
        .when(greenhouse_form(url), headed("greenhouse")).when(lever_form(url), headed("lever")).when(F.coalesce(ashby_published, F.lit(False)), headed("ashby")).otherwise(by("manual-only", "destination-not-reviewed"))
    )


def summaries(applications: DataFrame, jobs: DataFrame, boards: DataFrame, key: str = "job_id", status: str | None = None, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """``applications`` (key, status, apply_mode, ...) each with ``job``, null where there is none any more, and ``assistance`` of its address.

    ``boards`` is (board) of published Ashby boards. A status that is none of ``statuses`` raises; the filter comes before the join. Order is
    the reader's: :func:`gleaner.operators.reads.page` by updated_at.
    """
    if status is not None and status not in statuses:
        raise ValueError(f"status must be one of {', '.join(statuses)}")
    rows = applications if status is None else applications.where(F.col("status") == status)
    seen = jobs.select(key, F.struct(*JOB).alias("job")).dropDuplicates([key])
    both = rows.join(seen, key, "left").withColumn("_board", ashby_form(F.col("job.apply_url")))
    named = both.join(boards.select(F.col("board").alias("_published")).distinct(), F.col("_board") == F.col("_published"), "left")
    helped = F.when(F.col("job").isNotNull(), assistance(F.col("job.apply_url"), F.col("apply_mode"), F.col("_published").isNotNull()))
    return named.withColumn("assistance", helped).select(*rows.columns, "job", "assistance")


def digest_lines(jobs: DataFrame, pending: str, order: list[Column]) -> DataFrame:
    """(text, html) of the open jobs that wait for a digest, in ``order`` (a sort by ranges: no task holds all jobs); no rows, no mail."""
    c = F.col
    text = F.concat("company", F.lit(" — "), "title", F.lit(" ("), "location", F.lit(")\n"), "apply_url")
    e = lambda n: escape_html(c(n))
    html = F.concat(F.lit("<li><strong>"), e("company"), F.lit("</strong> — "), e("title"), F.lit(" ("), e("location"), F.lit(')<br><a href="'), e("apply_url"), F.lit('">Apply</a></li>'))
    return jobs.where(c(pending) & c("open")).orderBy(*order).select(text.alias("text"), html.alias("html"))
