"""What failures of sources are: category, outcome, and the labels under which runs are counted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.operators.messages import safe_diagnostic

#: Fixed values: (words of a message, category), the first that is found counts.
MESSAGE_CATEGORIES = [("application link|application host|eligible .* link", "link"), ("shape|schema|malformed json", "json"), ("quality|suspicious zero-row", "quality"), ("timeout|timed out|aborted|fetch|network|socket|econn", "transport")]


def failure_category(given: Column, message: Column) -> Column:
    """A failure's own category, else what its message speaks of, else ``persistence``."""
    text = F.lower(safe_diagnostic(F.coalesce(message, F.lit(""))))
    told = F.coalesce(*(F.when(text.rlike(pattern), F.lit(name)) for pattern, name in MESSAGE_CATEGORIES), F.lit("persistence"))
    return F.coalesce(given, told)


def failure_outcome(category: Column, status: Column, message: Column) -> Column:
    """The outcome of a run that failed: ``status`` is null where none came."""
    paged = safe_diagnostic(F.coalesce(message, F.lit(""))).rlike("(?i)pagination")
    return (
        F.when(status == 429, "rate_limited").when(status == 404, "not_found").when(status >= 500, "temporary_provider_error").when(category.isin("transport", "http"), "temporary_provider_error")
        .when(category == "json", F.when(paged, "incomplete_pagination").otherwise("invalid_schema")).when(category == "identity", "application_host_mismatch")
        .when(category.isin("empty", "quality"), "unexpected_raw_zero").when(category == "persistence", "catalog_write_failed").otherwise("failed")
    )


def provider_of(source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    return F.when(s.startswith("ashby-"), "ashby").when(s.startswith("lever-"), "lever").when(F.contains(s, F.lit("greenhouse-")), "greenhouse").when(s != "", "github").otherwise("unknown")


def region_of(provider: Column) -> Column:
    return F.when(provider.isin("lever", "ashby"), "global").otherwise("unknown")


def run_failure(category: Column) -> Column:
    """The label of a board's failed run."""
    same = category.isin("identity", "link", "empty", "quality", "persistence")
    return F.when(category == "json", "schema").when(same, category).otherwise("fetch")
