"""Which rows are the same item: keep-first, ordered fallback keys, components, similar titles and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.hashing import fingerprint
from gleaner.functions.text import canonical_company, canonical_location, canonical_title, generic_location, heads, overlap, own_head, plain_words
from gleaner.operators.lineage import drop, store


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, with ``copies``; a partial aggregate, so no key is hot."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("copies")).select(*keys, "_first.*", "copies")


def resolve(listings: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``listings`` with ``value`` of the stored row that agrees on the first key with a match, and that key's name.

    Stored keys are made unique first (the smallest value), so rows never multiply.
    """
    out = listings
    for key in keys:
        side = stored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min(value).alias(f"_by_{key}"))
        out = out.join(side, F.col(key) == F.col(f"_{key}"), "left")
    found = F.coalesce(*(F.col(f"_by_{k}") for k in keys))
    matched = F.coalesce(*(F.when(F.col(f"_by_{k}").isNotNull(), F.lit(k)) for k in keys))
    return out.withColumns({value: found, "matched_by": matched}).drop(*(f"_{k}" for k in keys), *(f"_by_{k}" for k in keys))


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: both sides are shuffled, so that it never passes through the driver."""
    return df.hint("merge")


def same_items(df: DataFrame, key: str, links: list[str], edges: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """(key, root): rows that agree on one of ``links``, or that ``edges`` (two columns of keys) join, directly or
    through others, have one root, the smallest key among them. A null link links nothing.

    Each round takes the least root of every link's rows, by partial minima before the shuffle, and the
    roots' own roots. It is written once, with what fell, and the round before goes.
    """
    spark, rows = df.sparkSession, df.select(key, *links)
    named = [rows.where(F.col(n).isNotNull()).select(key, F.xxhash64(F.lit(n), F.col(n).cast("string")).alias("_link"), F.concat_ws("|", F.lit(n), F.col(n).cast("string")).alias("_name")) for n in links]
    if edges is not None:
        a, b = edges.columns
        pair = F.concat_ws("|", F.lit("edge"), F.col(a).cast("string"), F.col(b).cast("string"))
        named += [edges.select(F.col(c).alias(key), F.xxhash64(pair).alias("_link"), pair.alias("_name")) for c in (a, b)]
    member = named[0]
    for x in named[1:]:
        member = member.unionByName(x)
    # Links of one row join nothing.
    shared = member.groupBy("_link", "_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    member, member_path = store(member.join(_dealt(shared), ["_link", "_name"], "left_semi").distinct(), "members")
    now, path = store(member.select(key).distinct().withColumn("root", F.col(key)), "roots")
    for _ in range(most_rounds):
        by_link = member.join(_dealt(now), key).groupBy("_link", "_name").agg(F.min("root").alias("_least"))
        least = member.join(_dealt(by_link), ["_link", "_name"]).groupBy(key).agg(F.min("_least").alias("_least"))
        jump = now.select(F.col(key).alias("_key"), F.col("root").alias("_jump"))
        next_ = now.join(_dealt(least), key).withColumn("_low", F.least("root", "_least")).join(_dealt(jump), F.col("_low") == F.col("_key"), "left")
        root = F.least("_low", F.coalesce("_jump", "_low"))
        after, after_path = store(next_.select(key, root.alias("root"), (root < F.col("root")).alias("fell")), "roots")
        fell = after.where("fell").limit(1).count()
        drop(spark, path)
        now, path = after.drop("fell"), after_path
        if not fell:
            drop(spark, member_path)
            return rows.select(key).join(_dealt(now), key, "left").select(key, F.coalesce("root", key).alias("root"))
    raise RuntimeError(f"roots did not settle in {most_rounds} rounds")


def role_links(df: DataFrame, key: str, company: str, season: str, title: str, repaired: str, least: float = 0.8) -> DataFrame:
    """(key, other): for each row with a repaired title the first earlier row (smallest key) that is the same role.

    Same company and season, and titles of which one begins with the other or of whose words at least
    the share ``least`` of the smaller set is shared. A title without a word is the same as none. Titles
    are made distinct first; candidates share one of the rarest words that so much overlap needs, or a
    title's first words, so frequent words of a large company make no pairs.
    """
    rows = df.select(F.col(key).alias("k"), plain_words(F.col(company)).alias("c"), F.coalesce(F.col(season).cast("string"), F.lit("")).alias("s"), plain_words(F.col(title)).alias("t"), F.coalesce(F.col(repaired), F.lit(False)).alias("r"))
    titles = rows.where("t <> ''").groupBy("c", "s", "t").agg(F.min("k").alias("first"), F.max(F.when(F.col("r"), F.col("k"))).alias("asks"))
    titles = titles.withColumn("words", F.array_distinct(F.split("t", " ")))
    word = titles.select("c", "s", "t", F.explode("words").alias("w"))
    rare = word.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ordered = word.join(rare, "w").groupBy("c", "s", "t").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    titles, path = store(titles.join(_dealt(ordered.select("c", "s", "t", F.transform("ws", lambda x: x["w"]).alias("rarest"))), ["c", "s", "t"]), "titles")
    size = F.size("rarest")
    prefix = F.slice("rarest", F.lit(1), size - F.ceil(size * least).cast("int") + 1)
    asks, base = titles.where("asks is not null"), ["c", "s"]
    whole = lambda d, words, name: d.select(*base, F.col("t").alias(name), F.size("rarest").alias(f"{name}_n"), F.explode(words).alias("w"))
    pairs = whole(asks, prefix, "a").join(_dealt(whole(titles, F.col("rarest"), "b")), [*base, "w"]).where("a_n <= b_n").select(*base, "a", "b")
    pairs = pairs.unionByName(whole(asks, F.col("rarest"), "a").join(_dealt(whole(titles, prefix, "b")), [*base, "w"]).where("a_n > b_n").select(*base, "a", "b"))
    longer = lambda d, name: d.select(*base, F.col("t").alias(name), F.explode(heads(F.col("t"))).alias("h"))
    shorter = lambda d, name: d.select(*base, F.col("t").alias(name), own_head(F.col("t")).alias("h"))
    pairs = pairs.unionByName(longer(asks, "a").join(_dealt(shorter(titles, "b")), [*base, "h"]).select(*base, "a", "b")).unionByName(shorter(asks, "a").join(_dealt(longer(titles, "b")), [*base, "h"]).select(*base, "a", "b"))
    wa, wb = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
    same = F.startswith("a", F.col("b")) | F.startswith("b", F.col("a")) | (overlap(wa, wb) >= least)
    found = pairs.distinct().where(same).join(_dealt(titles.select(*base, F.col("t").alias("b"), "first")), [*base, "b"]).groupBy(*base, "a").agg(F.min("first").alias("other"))
    return rows.where("r").join(_dealt(found.withColumnRenamed("a", "t")), [*base, "t"]).where("other < k").select(F.col("k").alias(key), "other")


def merge_listings(stored: DataFrame, listings: DataFrame, now: str) -> DataFrame:
    """Jobs after their listings, field by field, whatever the number of listings.

    ``stored`` has job, company, title, location, season, apply_url, url, validated_at, invalid_url,
    hourly and requirements; ``listings`` the same without invalid_url, and order, source_id,
    external_id, state and technical. Company and title stay once known; a placeholder of a location
    gives way to the first real one; the season is the last listing's, pay the last that is some,
    requirements the last that are given; an address goes to that of the last validated listing.
    References are one for each source and external id, as last listed. A job whose address was found
    invalid stays closed while its listings name no other. All are partial aggregates by job.
    """
    both = stored.withColumn("order", F.lit(-1).cast("long")).unionByName(listings, allowMissingColumns=True)
    said = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("order"))
    listed, real = F.col("order") >= 0, ~generic_location(F.col("location"))
    valid = F.when(listed & F.col("validated_at").isNotNull(), F.col("order"))
    at = lambda c, when: F.min_by(c, when)
    last = lambda c, when: F.max_by(c, when)
    jobs = both.groupBy("job").agg(
        at("company", said("company")).alias("company"),
        at("title", said("title")).alias("title"),
        F.coalesce(at("location", F.when(real, F.col("order"))), last("location", said("location"))).alias("location"),
        last("season", "order").alias("season"),
        F.coalesce(last("apply_url", valid), at("apply_url", said("apply_url"))).alias("apply_url"),
        F.coalesce(last("url", valid), at("url", said("url"))).alias("url"),
        F.coalesce(last("validated_at", valid), F.max(F.when(~listed, F.col("validated_at")))).alias("validated_at"),
        last("hourly", F.when((F.col("hourly") > 0) | ~listed, F.col("order"))).alias("hourly"),
        last("requirements", F.when(F.col("requirements").isNotNull(), F.col("order"))).alias("requirements"),
        F.max("invalid_url").alias("_invalid"),
        F.count_if(listed).alias("n_listings"),
        F.collect_set(F.when(listed, F.col("url"))).alias("_urls"),
    )
    refs = listings.groupBy("job", "source_id", "external_id").agg(F.max_by(F.struct("state", F.coalesce("technical", F.lit(True)).alias("technical")), "order").alias("x"))
    opened = F.col("x.state") == "open"
    refs = refs.groupBy("job").agg(F.bool_or(opened).alias("any_open"), F.bool_or(opened & F.col("x.technical")).alias("technical"), F.array_sort(F.collect_list(F.concat_ws("|", "source_id", "external_id", "x.state"))).alias("references"))
    out = jobs.join(refs, "job", "left")
    invalid = F.col("_invalid").isNotNull() & ~F.exists("_urls", lambda u: u != F.col("_invalid"))
    key = fingerprint(canonical_company(F.col("company")), canonical_title(F.col("title")), canonical_location(F.col("location")), F.lower(F.coalesce("season", F.lit(""))))
    return out.select(
        "job", "company", "title", "location", "season", "apply_url", "url", "validated_at", "hourly", "requirements", F.when(invalid, F.col("_invalid")).alias("invalid_url"),
        (F.coalesce("any_open", F.lit(False)) & ~invalid).alias("open"), F.coalesce("technical", F.lit(False)).alias("technical"), "references", "n_listings", key.alias("fingerprint"), F.lit(now).alias("last_seen_at"),
    )


def close_reference(references: Column, source: Column, external: Column) -> Column:
    """The references ``source|external|state`` with one of them closed."""
    name = F.concat_ws("|", source, external)
    return F.transform(references, lambda r: F.when(F.regexp_replace(r, r"\|[^|]*$", "") == name, F.concat(name, F.lit("|closed"))).otherwise(r))


def merge(df: DataFrame, root: str, key: str, title: str, source: str, first: str, last: str, is_open: Column) -> DataFrame:
    """One row for each root: the title of its smallest key, first and last sighting, its distinct sources
    in order, whether any of it is open, and how many rows it has. All are partial aggregates."""
    return df.groupBy(root).agg(
        F.min_by(title, F.when(F.col(title).isNotNull(), F.col(key))).alias("title"), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"),
        F.array_sort(F.collect_set(source)).alias("sources"), F.bool_or(is_open).alias("is_open"), F.count(F.lit(1)).alias("n_rows"),
    )
