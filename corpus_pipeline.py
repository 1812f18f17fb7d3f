"""A training corpus from documents: stages of the corpus operators, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import TEXT_ROWS, clear, documents, filter_words, materialize, with_hits
from gleaner.llm.jaccard import near_copy_components
from gleaner.llm.packing import pack_documents
from gleaner.llm.pii import redact
from gleaner.llm.repeats import remove_repeats
from gleaner.llm.toxicity import score_toxicity, train_on


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; a null or empty text is not toxic."""
    model = train_on(docs, documents(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("toxic = 0").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id.

    Rows of one id stay if they are their group's smallest, but equal ones only once; rows without
    an id cannot be named and stay, equal ones once.
    """
    found = near_copy_components(docs)
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component_id"))
    ids, _ = materialize(ids, "groups")
    # Most documents are alone or first of their group: a filter of the other ids shows them, so their texts stay where they are.
    others = ids.where("doc_id <> component_id or rows > 1").select(F.xxhash64("doc_id").alias("name"))
    marked = with_hits(docs, F.xxhash64("doc_id"), filter_words(others)).withColumn("_hit", F.col("_hit") | F.col("doc_id").isNull())
    plain, rest = marked.where(~F.col("_hit")).drop("_hit"), marked.where("_hit").drop("_hit")
    kept = ids.where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id"), "rows")
    on = rest["doc_id"].eqNullSafe(F.col("_id"))
    once = rest.join(kept.where("rows = 1"), on, "left_semi")
    several = rest.join(kept.where("rows > 1"), on, "left_semi")
    return plain.unionByName(once).unionByName(several.dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that occur elsewhere; documents that nothing is left of go.

    A text that was null or empty before has lost nothing and stays.
    """
    cut = remove_repeats(docs.withColumn("_empty", F.coalesce(F.col("text") == "", F.lit(False))))
    cut = cut.where("_empty or text is null or text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence of at most 2048 ids and its place there.

    Executors have run four stages by now, so workers hold half the text at a time that they hold in packing alone.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, chunks=200_000, group_chars=2_000_000, rows=TEXT_ROWS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]
#: SQL has no string-kernel machine, suffix order, random field or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents: a row for each piece of what is kept, as packing gives it.

    Each stage is written before the next one reads it, and what earlier stages wrote then goes; call
    :func:`gleaner.llm.common.clear` when the result is written. An empty table gives no rows; nulls,
    repeated rows and further columns are as the stages say.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
