"""Texts of times: dates, ages and monitoring periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def posting_date(at: Column) -> Column:
    """As in ``Jan 5, 2024``; null stays null."""
    return F.date_format(at, "MMM d, yyyy")


def monitoring_period(at_utc: Column, zone: str = "America/New_York") -> Column:
    """Year and month of a UTC time in a zone."""
    return F.date_format(F.from_utc_timestamp(at_utc, zone), "yyyy-MM")


def compact_age(seconds: Column, at: Column) -> Column:
    """``just now`` below a minute, then whole minutes, hours and days ago, from a week on the date."""
    past = F.greatest(seconds, F.lit(0))
    whole = lambda unit, mark: F.concat(F.floor(past / unit).cast("string"), F.lit(f"{mark} ago"))
    return F.when(past < 60, "just now").when(past < 3600, whole(60, "m")).when(past < 86400, whole(3600, "h")).when(past < 7 * 86400, whole(86400, "d")).otherwise(posting_date(at))


def freshness_label(seconds: Column, at: Column) -> Column:
    """How long ago a role was confirmed: today, yesterday, days, from a week on the date."""
    days = F.floor(F.greatest(seconds, F.lit(0)) / 86400)
    return (
        F.when(at.isNull() | seconds.isNull(), "Confirmation time unavailable").when(days == 0, "Confirmed today").when(days == 1, "Confirmed yesterday")
        .when(days < 7, F.concat(F.lit("Confirmed "), days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit("Confirmed "), posting_date(at)))
    )


#: Dates, and times with a zone, as sources must write them.
_ABSOLUTE = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))?$"
_PUBLISHED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
_HTTP_DATE = "EEE, dd MMM yyyy HH:mm:ss z"


def absolute_time(text: Column) -> Column:
    """The text if it is a date, or a time with a zone, of the calendar; else null."""
    return F.when(text.rlike(_ABSOLUTE) & F.try_to_timestamp(text).isNotNull(), text)


def is_published_time(text: Column) -> Column:
    """Whether a text is a time with a zone, of the calendar and the clock."""
    return F.coalesce(text.rlike(_PUBLISHED) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or how long until a date (0 if it is past); null for anything else."""
    value = F.trim(header)
    number = F.when(value.rlike(r"^\d+(?:\.\d+)?$"), value.cast("double"))
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit(_HTTP_DATE.split(", ")[1])))
    return F.coalesce(number, F.when(date.isNotNull(), F.greatest(date - now, F.lit(0)).cast("double")))
