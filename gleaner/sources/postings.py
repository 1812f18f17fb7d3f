"""Provider payloads and list documents as neutral postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.season import max_hourly_pay
from gleaner.functions.url import normalize_url
from gleaner.sources.lists import ROW, parse_lists

POSTING = "source_id, external_id, title, content, location, apply_url, state, authority"
GREENHOUSE = "jobs array<struct<id:string,internal_job_id:string,title:string,location:struct<name:string>,updated_at:string,absolute_url:string,content:string>>"
LEVER = "id string, text string, applyUrl string, hostedUrl string, descriptionPlain string, createdAt bigint, updatedAt bigint, categories struct<location:string,commitment:string,team:string,allLocations:array<string>>, workplaceType string"
ASHBY = "apiVersion string, jobs array<struct<id:string,title:string,location:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionHtml:string,descriptionPlain:string,publishedAt:string,jobUrl:string,applyUrl:string>>"


def read_boards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents by schema; a malformed one fails the read, as a snapshot must be complete."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("document", F.input_file_name())


def greenhouse_postings(boards: DataFrame, source: str) -> DataFrame:
    """A posting without an internal job id is a prospect."""
    j = boards.select(F.explode("jobs").alias("j"))
    return j.select(F.lit(source).alias("source_id"), F.col("j.id").alias("external_id"), F.col("j.title").alias("title"), F.col("j.content").alias("content"), F.col("j.location.name").alias("location"), F.col("j.absolute_url").alias("apply_url"), F.when(F.col("j.internal_job_id").isNull(), "prospect").otherwise("open").alias("state"), F.lit("title").alias("authority"))


def lever_postings(rows: DataFrame, source: str) -> DataFrame:
    places = F.coalesce(F.array_join("categories.allLocations", " / "), F.col("categories.location"))
    return rows.select(F.lit(source).alias("source_id"), F.col("id").alias("external_id"), F.col("text").alias("title"), F.col("descriptionPlain").alias("content"), places.alias("location"), F.col("applyUrl").alias("apply_url"), F.lit("open").alias("state"), F.when(F.col("categories.commitment").rlike("(?i)intern"), "posting").otherwise("title").alias("authority"))


def ashby_postings(boards: DataFrame, source: str) -> DataFrame:
    """Only listed jobs."""
    j = boards.select(F.explode("jobs").alias("j")).where("j.isListed")
    return j.select(F.lit(source).alias("source_id"), F.col("j.id").alias("external_id"), F.col("j.title").alias("title"), F.coalesce("j.descriptionHtml", "j.descriptionPlain").alias("content"), F.col("j.location").alias("location"), F.col("j.applyUrl").alias("apply_url"), F.lit("open").alias("state"), F.lit("title").alias("authority"))


def list_postings(documents: DataFrame, source: str, text: str = "value", document: str = "document", layout: str = "tables") -> DataFrame:
    """Postings of list documents; the first row of each address in a document stays. Refused addresses go."""
    rows = documents.select(F.col(document).alias("document"), F.explode(parse_lists(F.col(text), layout)).alias("r")).select("document", "r.*")
    rows = rows.where(F.lower("apply_url").startswith("https://")).withColumn("_url", normalize_url(F.col("apply_url")))
    first = rows.groupBy("document", "_url").agg(F.min_by(F.struct(*ROW.names), "row").alias("f"))
    pay = max_hourly_pay(F.col("f.pay"))
    return first.select(
        F.lit(source).alias("source_id"), F.concat_ws(":", "document", "_url").alias("external_id"), F.col("f.company").alias("company"), F.col("f.title").alias("title"), F.col("f.location").alias("location"), F.col("f.apply_url").alias("apply_url"),
        F.when(F.col("f.closed"), "closed").otherwise("open").alias("state"), pay.alias("max_hourly"), F.col("f.citizenship").alias("citizenship"), F.col("f.degree").alias("degree"), F.col("f.posted").alias("posted"),
    )
