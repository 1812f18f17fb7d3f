"""Neutral postings as listings: one projection with a decision for each, nothing dropped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.season import infer_season, max_hourly_pay, work_mode
from gleaner.functions.text import collapse, has_word, heads, html_to_text, markdown_to_text, own_head, plain_words
from gleaner.functions.url import url_rejection
from gleaner.operators.classify import Dictionary, with_technical

#: What a text says when it asks for citizenship or for an advanced degree, within a sentence.
_CITIZEN = r"(?:u\.?s\.?|united states)\s+citizens?"
_DEGREE = r"(?:advanced degree|master'?s|ph\.?d\.?|doctorate|mba)"
CITIZENSHIP = rf"(?i)(?:\b(?:must|requires?|requirement|eligible only|only)\b[^.]{{0,120}}{_CITIZEN}|{_CITIZEN}[^.]{{0,80}}\b(?:required|only|must)\b)"
ADVANCED_DEGREE = rf"(?i)(?:\b(?:must|requires?|requirement|eligible only)\b[^.]{{0,120}}{_DEGREE}|{_DEGREE}[^.]{{0,80}}\b(?:required|must)\b)"
CUT = r"(?:\.{3}|\x{2026})\s*$"


def content_text(content: Column) -> Column:
    """The text of (format, value) parts, one space apart."""
    return collapse(F.array_join(F.transform(content, lambda p: F.when(p["format"] == "markdown", markdown_to_text(p["value"])).otherwise(html_to_text(p["value"]))), " "))


def repair_titles(df: DataFrame, owner: str, title: str, known: list[str]) -> DataFrame:
    """``df`` with ``repaired``: a title that ends in dots becomes the owner's shortest whole title that begins
    with it (the first by text of equal length), else the longest of ``known`` that it begins with, else what is
    readable before the dots. Titles meet by whole words, so an owner's titles are not paired."""
    text = F.trim(F.coalesce(F.col(title), F.lit("")))
    stem = F.trim(F.regexp_replace(text, CUT, ""))
    rows = df.withColumns({"_owner": F.lower(F.coalesce(F.col(owner), F.lit(""))), "_title": text, "_cut": text.rlike(CUT), "_stem": stem, "_words": plain_words(stem)})
    whole = rows.where("not _cut and _words <> ''").select("_owner", F.col("_title").alias("_whole"), "_words").distinct()
    asks = rows.where("_cut and _words <> ''").select("_owner", F.col("_words").alias("_asked")).distinct().withColumn("_head", own_head(F.col("_asked")))
    found = asks.join(whole.withColumn("_head", F.explode(heads(F.col("_words")))), ["_owner", "_head"]).where(F.startswith("_words", F.col("_asked")))
    best = found.groupBy("_owner", "_asked").agg(F.min(F.struct(F.length("_whole").alias("n"), F.col("_whole").alias("t")))["t"].alias("_best")).withColumnRenamed("_asked", "_words")
    words = F.col("_words")
    canonical = F.coalesce(*(F.when(F.startswith(words, plain_words(F.lit(k))), F.lit(k)) for k in sorted(known, key=len, reverse=True)), F.lit(None).cast("string"))
    readable = F.trim(F.regexp_replace("_stem", r"[\s(\[{,\-\x{2013}\x{2014}/]+\S*$", ""))
    left = F.when(readable != "", readable).otherwise(F.col("_stem"))
    repaired = F.when(~F.col("_cut") | (words == ""), F.col("_title")).otherwise(F.coalesce("_best", canonical, left))
    return rows.join(best, ["_owner", "_words"], "left").withColumn("repaired", repaired).select(*df.columns, "repaired")


def requirements(content: Column, citizenship: Column, degree: Column) -> tuple[Column, Column]:
    """Whether citizenship and an advanced degree are asked for: as declared, else as the text says."""
    return F.coalesce(citizenship, content.rlike(CITIZENSHIP)), F.coalesce(degree, content.rlike(ADVANCED_DEGREE))


def process_postings(postings: DataFrame, words: Dictionary, known_titles: list[str], aggregators: list[str], now: dt.date) -> DataFrame:
    """Every posting as a listing with ``outcome`` and ``reason``.

    ``postings`` has source_id, external_id, company, title, content (parts), locations, season_hint,
    season_authority, apply_url, state, authority, tags, declared_mode, citizenship, degree and pay_text;
    further columns go along. Decisions in order: prospects; postings whose repaired title has no word of the life cycle
    (unless the source or the posting vouches); refused addresses; technical ones are included and others
    shelved. The title's season comes before the source's hint, that before the text's.
    """
    clean = postings.withColumns({"_source_title": html_to_text(F.col("title")), "company": html_to_text(F.col("company")), "_content": content_text(F.col("content"))})
    rows = repair_titles(clean, "company", "_source_title", known_titles)
    places = F.filter(F.transform(F.coalesce("locations", F.array().cast("array<string>")), html_to_text), lambda x: x != "")
    location = F.when(F.size(places) > 0, F.array_join(places, " / ")).otherwise("Unspecified")
    said = infer_season(F.col("repaired"), now)
    rows = rows.withColumns({
        "_location": location,
        "_said": said,
        "_about": F.array_join(F.filter(F.concat(F.array("repaired"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), html_to_text)), lambda x: x != ""), " "),
    })
    rows = with_technical(rows, "_about", "_content", words)
    rejection = url_rejection(F.col("apply_url"), aggregators)
    vouched = F.coalesce(F.col("authority").isin("source", "posting"), F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("state") == "prospect", F.lit(False)), "prospect")
        .when(~vouched & ~has_word(F.col("repaired"), words.lifecycle), "not-early-career")
        .when(rejection == "aggregator", "aggregator-destination").when(rejection.isNotNull(), "invalid-application-url")
        .when(F.col("technical"), "source-policy").otherwise("nontechnical")
    )
    outcome = F.when(F.col("reason").isin("prospect", "not-early-career"), "filtered").when(F.col("reason").isin("aggregator-destination", "invalid-application-url"), "withheld").when(F.col("reason") == "source-policy", "included").otherwise("shelved")
    unsaid = F.col("_said") == "ongoing"
    citizen, degree = requirements(F.col("_content"), F.col("citizenship"), F.col("degree"))
    own = {"title", "content", "locations", "season_hint", "season_authority", "tags", "declared_mode", "citizenship", "degree", "pay_text", "company"}
    return rows.withColumn("reason", reason).select(
        *(c for c in postings.columns if c not in own),
        "company",
        F.col("repaired").alias("title"),
        (F.col("repaired") != F.col("_source_title")).alias("title_repaired"),
        F.col("_location").alias("location"),
        F.when(~unsaid, F.col("_said")).otherwise(F.coalesce("season_hint", infer_season(F.col("_content"), now))).alias("season"),
        F.when(unsaid & (F.col("season_authority") == "source-default"), "source-default").alias("season_source"),
        F.coalesce(work_mode(F.coalesce("declared_mode", F.lit(""))), work_mode(F.concat_ws(" ", "_location", "_content"))).alias("work_mode"),
        max_hourly_pay(F.coalesce("pay_text", "_content")).alias("max_hourly"),
        citizen.alias("citizenship"),
        degree.alias("degree"),
        "technical",
        "basis",
        outcome.alias("outcome"),
        "reason",
    )
