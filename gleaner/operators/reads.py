"""Catalog reads: keyset pages, what is new since a time, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page(df: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows by (column, descending) keys after the key values given."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after):
            beyond = beyond | (equal & ((F.col(name) < F.lit(value)) if down else (F.col(name) > F.lit(value))))
            equal = equal & (F.col(name) == F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*(F.col(n).desc() if down else F.col(n).asc() for n, down in order)).limit(size)


def since(df: DataFrame, at: str, after, before) -> DataFrame:
    """Rows later than ``after``, up to and including ``before``."""
    return df.where((F.col(at) > F.lit(after)) & (F.col(at) <= F.lit(before)))


def score(weight: Column, hourly: Column) -> Column:
    return F.coalesce(weight, F.lit(0)) + F.least(F.coalesce(hourly, F.lit(0.0)), F.lit(100.0)) / 2


def not_among(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")


def search_text(*parts: Column) -> Column:
    """What a catalog search looks into: all parts in lower case."""
    return F.lower(F.concat_ws(" ", *parts))


def source_classes(direct: Column, community: Column) -> Column:
    """``all``, and direct, community or both with corroborated."""
    return F.array_compact(F.array(F.lit("all"), F.when(direct, "direct"), F.when(community, "community"), F.when(direct & community, "corroborated")))


def open_sort_key(is_baseline: Column, visible_at: Column, key: Column) -> Column:
    """A text by which descending order gives normal rows before baseline ones, then later, then larger keys first."""
    return F.concat_ws("#", F.when(is_baseline, "1").otherwise("3"), F.date_format(visible_at, "yyyy-MM-dd'T'HH:mm:ss"), key.cast("string"))


def listed(df: DataFrame, status: str, technical: Column, past: Column, classes: Column, wanted: str, text: Column, part: str) -> DataFrame:
    """The catalog list: of a status, not known to be untechnical, not past, of a class, with a part of the search text."""
    return df.where((F.col("status") == status) & F.coalesce(technical, F.lit(True)) & ~past & F.array_contains(classes, wanted) & text.contains(part.lower()))


def inbox(df: DataFrame, order: list[tuple[str, bool]], size: int = 50) -> DataFrame:
    """The first ``size`` rows with the total and whether there are more."""
    total = df.select(F.count(F.lit(1))).scalar()
    return page(df, order, size).withColumn("total", total).withColumn("has_more", F.col("total") > size)


def inbox_then_feed(inbox_rows: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Inbox rows, then the feed's rows that it does not have; ``part`` is 0 and 1."""
    return inbox_rows.withColumn("part", F.lit(0)).unionByName(feed.join(inbox_rows, key, "left_anti").withColumn("part", F.lit(1)))
