"""The driver's tables under the names that the operators use, and the queries' dictionaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators.classify import Dictionary

#: Words that the synthetic texts hold, in the place of a catalog's own dictionaries.
WORDS = Dictionary(
    lifecycle="est|und|the",
    strong="inge|thing|ou|onre|réque|ment",
    stack="and|für|der|por|que|les|des|pour|ing|ind",
    business="was|wh|die|las|del",
    categories={"articles": "der|die|das|les|las|the", "joining": "und|and|et|y", "pointing": "of|de|von|del"},
)
NOW = dt.date(2024, 1, 31)
AGGREGATORS = ["thther.example.org", "blog.tiontion.example.com"]
SUFFIXES = ["co.uk", "com.au"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the whole text is title and content, all have a good address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("external_id"), text.alias("title"), text.alias("content"), F.lit("https://jobs.example.com/").alias("apply_url"), F.lit("open").alias("state"), F.lit("title").alias("authority"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1).alias("title"))
