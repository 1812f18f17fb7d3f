"""Ledgers of sources: modes with tie-breaks, concentration gates, orphans, first sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def candidate_ledger(sightings: DataFrame, site: str, name: str, source: str) -> DataFrame:
    """For each site its sightings, sources, and most frequent name (ties to the first by name)."""
    names = sightings.groupBy(site, name).agg(F.count(F.lit(1)).alias("n"))
    mode = names.groupBy(site).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(name).alias("v")))["v"].alias("name"), F.count(F.lit(1)).alias("variants"))
    sums = sightings.groupBy(site).agg(F.count(F.lit(1)).alias("sightings"), F.count_distinct(source).alias("sources"))
    return sums.join(mode, site)


def concentration(df: DataFrame, source: str, key: str, most: float) -> DataFrame:
    """For each source its keys, the largest share of one key, and whether that passes ``most``."""
    counts = df.groupBy(source, key).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(source).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"))
    return out.withColumn("too_concentrated", F.col("largest") > most * F.col("n_rows"))


def ambiguous(df: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Keys that more than one owner claims."""
    return df.groupBy(*key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def orphans(registry: DataFrame, evidence: DataFrame, left: str, right: str) -> DataFrame:
    """(id, side): registry rows without evidence and evidence without a registry row."""
    ids, seen = registry.select(F.col(left).alias("id")).distinct(), evidence.select(F.col(right).alias("id")).distinct()
    return ids.join(seen, "id", "left_anti").withColumn("side", F.lit("registry")).unionByName(seen.join(ids, "id", "left_anti").withColumn("side", F.lit("evidence")))


def earliest_publication(df: DataFrame, key: str, at: str, official: str, label: str) -> DataFrame:
    """The earliest official time of each key, else the earliest of any kind, with its label."""
    best = F.min(F.struct((~F.col(official)).alias("o"), F.col(at).alias("t"), F.col(label).alias("l"))).alias("b")
    return df.groupBy(key).agg(best).select(key, F.col("b.t").alias("published_at"), F.col("b.l").alias("published_by"), (~F.col("b.o")).alias("is_official"))


def carry_forward(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``df`` with ``carried``: the last value that is neither null nor empty, up to each row."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(upto))


def later_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of two registries; of rows with one key those of the second stay."""
    return first.join(second, key, "left_anti").unionByName(second, allowMissingColumns=True)


def missing(requested: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Requested keys that were not discovered."""
    return requested.select(key).distinct().join(discovered, key, "left_anti")


def require_none(rows: DataFrame, what: str) -> None:
    """Raise if there are rows, naming a few of them."""
    some = rows.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {', '.join(str(r[0]) for r in some)}")


def samples(df: DataFrame, group: str, order: str, value: str, n: int = 3) -> DataFrame:
    """For each group its count and its first ``n`` values in input order, without gathering the group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = df.withColumn("_nth", nth).where(F.col("_nth") <= n).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_nth", F.col(value).alias("v")))).alias("s"))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(few, group).select(group, "n_rows", F.transform("s", lambda x: x["v"]).alias("samples"))


def summary(df: DataFrame, group: str, kind: str, place: str) -> DataFrame:
    """For each group its rows, its kinds with their counts as a map, and its distinct places."""
    kinds = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    counts = kinds.groupBy(group).agg(F.sum("n").alias("n_rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))  # an entry a kind
    return counts.join(df.groupBy(group).agg(F.count_distinct(place).alias("places")), group)
