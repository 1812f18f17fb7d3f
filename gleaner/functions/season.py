"""Seasons, pay and work mode from text; the present time is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

#: The month (from 1) in which a season begins.
SEASON_MONTH = {"winter": 1, "spring": 3, "summer": 5, "fall": 9}
_NAMED = r"(?i)(?<![A-Za-z0-9_])(summer|fall|spring|winter)\s*(?:intern(?:ship)?\s*)?(20\d{2})(?![A-Za-z0-9_])"
_YEAR = r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"
_AMOUNT = r"\s*(\d+(?:\.\d+)?)\s*(?:-|–|to)?\s*\$?\s*(\d+(?:\.\d+)?)?\s*(?:/|per\s*)?"


def infer_season(text: Column, now: dt.date) -> Column:
    """A named season and year, else the first year from now to three years on, else ``ongoing``."""
    name, year = F.lower(F.regexp_extract(text, _NAMED, 1)), F.regexp_extract(text, _NAMED, 2)
    years = F.filter(F.regexp_extract_all(text, F.lit(_YEAR), F.lit(1)), lambda y: y.cast("int").between(now.year, now.year + 3))
    return F.when(name != "", F.concat_ws("-", name, year)).otherwise(F.coalesce(F.get(years, F.lit(0)), F.lit("ongoing")))


def is_past_season(season: Column, now: dt.date) -> Column:
    """A named season is past once its first month is over; a bare year once it is over."""
    low = F.lower(season)
    name, named = F.regexp_extract(low, r"^(winter|spring|summer|fall)-(20\d{2})$", 1), F.regexp_extract(low, r"^(winter|spring|summer|fall)-(20\d{2})$", 2).try_cast("int")
    bare = F.regexp_extract(low, r"^(?:offseason-)?(20\d{2})$", 1).try_cast("int")
    begun = F.coalesce(*(F.when(name == k, F.lit(now.month > m)) for k, m in SEASON_MONTH.items()), F.lit(False))
    return F.when(named.isNotNull(), (named < now.year) | ((named == now.year) & begun)).otherwise(F.coalesce(bare < now.year, F.lit(False)))


def _highest(text: Column, pattern: str) -> Column:
    low, high = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.array_max(F.zip_with(low, high, lambda a, b: F.when(b != "", b).otherwise(a).cast("double")))


def max_hourly_pay(text: Column) -> Column:
    """The upper end of hourly pay, else of annual pay (with a dollar sign) by 2080 hours."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, ",", ""), r"\s+", " "))
    hourly = _highest(clean, r"(?i)\$?" + _AMOUNT + r"(?:hr|hour)(?![A-Za-z0-9_])")
    annual = _highest(clean, r"(?i)\$" + _AMOUNT + r"(?:year|yr|annum)(?![A-Za-z0-9_])")
    return F.coalesce(hourly, annual / 2080)


def work_mode(text: Column) -> Column:
    return F.when(text.rlike("(?i)remote"), "remote").when(text.rlike("(?i)hybrid"), "hybrid").when(text.rlike("(?i)on.?site|in.?person"), "onsite")
