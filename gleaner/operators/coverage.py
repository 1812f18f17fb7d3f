"""Companies over all that observes them: feeds, reviewed boards and seeds, under one name for all their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import COMPANY_SUFFIXES, folded
from gleaner.operators.identity import same_items

#: What observes a company, and its states, the strongest first.
OBSERVATION = "name string, source_id string, season string, provider string, status string, listings long, seed boolean"
STATES = ("direct-published", "direct-shadow", "feed-observed", "candidate-only")


def company_key(name: Column, suffixes: tuple[str, ...] = COMPANY_SUFFIXES, fold=folded) -> Column:
    """A company's name as words of a-z and 0-9 without the endings that do not tell companies apart."""
    words = F.trim(F.regexp_replace(F.replace(fold(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, f"(?<=.)( ({'|'.join(suffixes)}))+$", "")


def observations(*parts: DataFrame) -> DataFrame:
    """All observations; columns that a part lacks are null."""
    columns = [c.split() for c in OBSERVATION.split(", ")]
    out = None
    for part in parts:
        rows = part.select(*((F.col(n) if n in part.columns else F.lit(None)).cast(t).alias(n) for n, t in columns))
        out = rows if out is None else out.unionByName(rows)
    return out


def alias_names(aliases: DataFrame, fold=folded) -> DataFrame:
    """(name, company): for every name in (alias, name) rows, the one that its aliases lead to in the end.

    Names that are linked through any number of aliases are one company. Its name is the smallest of
    those that are no alias of another; in a ring of aliases the smallest of all.
    """
    edges = aliases.select(company_key(F.col("alias"), fold=fold).alias("a"), company_key(F.col("name"), fold=fold).alias("b")).where("a <> '' and b <> '' and a <> b").distinct()
    names = edges.select(F.col("a").alias("name")).unionByName(edges.select(F.col("b").alias("name"))).distinct()
    roots = same_items(names, "name", [], edges)
    last = roots.join(edges.select(F.col("a").alias("name")).distinct(), "name", "left_anti").groupBy("root").agg(F.min("name").alias("company"))
    return roots.join(last, "root", "left").select("name", F.coalesce("company", "root").alias("company"))


def company_coverage(seen: DataFrame, aliases: DataFrame, fold=folded) -> DataFrame:
    """A row for each company: its state by precedence, listings, and the sets of all that is known of it.

    Names that leave no word are no company. All are partial aggregates.
    """
    keyed = seen.withColumn("_key", company_key(F.col("name"), fold=fold)).where("_key <> ''")
    named = keyed.join(alias_names(aliases, fold).withColumnRenamed("name", "_alias"), F.col("_key") == F.col("_alias"), "left")
    rows = named.withColumn("company_id", F.replace(F.coalesce("company", "_key"), F.lit(" "), F.lit("-")))
    direct = F.when(F.col("provider").isNotNull(), F.concat_ws(":", "provider", "source_id", "status"))
    feed = F.coalesce("listings", F.lit(0)) > 0
    some = lambda c, when: F.array_sort(F.collect_set(F.when(when, c)))
    known = rows.groupBy("company_id").agg(
        F.coalesce(F.sum("listings"), F.lit(0)).alias("listings"),
        some(F.col("source_id"), feed).alias("source_ids"),
        some(F.col("season"), feed).alias("seasons"),
        F.array_sort(F.collect_set(F.trim("name"))).alias("names"),
        F.array_sort(F.collect_set(direct)).alias("direct_sources"),
        some(F.col("provider"), F.col("provider").isNotNull()).alias("providers"),
        F.bool_or(F.coalesce(F.col("status") == "published", F.lit(False))).alias("_published"),
        F.bool_or(F.coalesce(F.col("status") == "shadow", F.lit(False))).alias("_shadow"),
        F.bool_or(F.coalesce("seed", F.lit(False))).alias("seed"),
    )
    state = F.when(F.col("_published"), STATES[0]).when(F.col("_shadow"), STATES[1]).when(F.col("listings") > 0, STATES[2]).otherwise(STATES[3])
    return known.withColumn("state", state).drop("_published", "_shadow")


def coverage_counts(companies: DataFrame) -> DataFrame:
    """One row: companies, those with listings, those of each state, and all listings."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s.replace("-", "_"))
    return companies.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("listings") > 0).alias("observed"), *map(of, STATES), F.coalesce(F.sum("listings"), F.lit(0)).alias("listings"))


def search_companies(companies: DataFrame, part: str = "", state: str | None = None, size: int = 50, skip: int = 0) -> DataFrame:
    """A page of companies by name with a part of it and a state; 1 to 100 rows."""
    out = companies.where(F.contains(F.replace("company_id", F.lit("-"), F.lit(" ")), F.lit(part.lower())))
    out = out.where(F.col("state") == state) if state else out
    return out.orderBy("company_id").offset(max(0, skip)).limit(min(100, max(1, size)))
