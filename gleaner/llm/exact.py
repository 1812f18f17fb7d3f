"""Exact copies by an extendible-hash index on shared files.

Texts are normalised (each stretch of white space is one space) and hashed to 64 bits. The index
has an entry for each distinct text, in buckets of at most ``capacity`` keys: a bucket that holds
more is split by the next bit of its keys, and the directory doubles until all fit. Directory and
entries are tables in the shared folder; owner tasks hold ranges of buckets, chain the texts whose
hashes collide, and write their entries in order. Texts are grouped by their whole bytes, where
they are read first, so a text that a third of all rows share leaves a map task once. Only texts
whose key occurs again are compared; the others are alone for certain.

Everything is DataFrame functions. A null text counts as empty, and empty texts are equal. Of equal
texts the row with the smallest key stays; rows of one key that are equal have the same answer, and
:func:`drop_exact_copies` keeps one of them. Rows without a key never go before others: they are
dropped if an equal row has a key, and stay otherwise. Keys may have any type with an order. An
empty table gives no rows. Only the columns named are read, so others may be there.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from gleaner.llm.common import documents, filter_words, materialize, with_hits

#: Keys that a bucket holds before it is split.
CAPACITY = 20_000
#: A text is hot if more than one row in so many has it; there are fewer hot texts than that.
HOT_PARTS = 1000


def normalised(text: Column) -> Column:
    """The text with every stretch of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hash(text: Column, bits: int) -> Column:
    return F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftright(F.xxhash64(text), 64 - bits), 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, bucket, depth): a row for each slot of the directory over the column ``hash``, whose keys are distinct.

    A bucket is named by its first slot; 2**depth is the share of the slots that point to it. The
    counts of all doublings come from one aggregate over cells somewhat finer than the buckets can
    be: of every key's buckets the first that fits is the one without further splits. Keys that the
    finest cells cannot tell apart stay in one bucket, whatever their number.
    """
    total = keys.count()
    finest = max(1, ceil(log2(max(2, total / capacity))) + 4)
    cells = keys.groupBy(F.shiftrightunsigned("hash", 64 - finest).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    every = F.create_map(*(x for d in range(finest + 1) for x in (F.lit(d), F.call_function("shiftright", F.col("cell"), F.lit(finest - d)))))
    splits = cells.select("n", F.explode(every).alias("depth", "prefix")).groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = (F.col("n") <= capacity) | (F.col("depth") == finest)
    full = splits.where(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = keys.sparkSession.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("prefix"))
    both = full.unionByName(root).join(splits.select("depth", "prefix", "n"), ["depth", "prefix"], "left")
    leaves, _ = materialize(both.where(F.coalesce(fits, F.lit(True))).select("depth", "prefix"), "copies-buckets")
    top = leaves.agg(F.max("depth")).first()[0]
    share = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(top) - F.col("depth"))
    first = F.col("prefix") * share
    return leaves.select(F.explode(F.sequence(first, first + share - 1)).alias("slot"), first.alias("bucket"), "depth")


def _keyed(df: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    body = normalised(F.col(text))
    return df.select(F.col(key).alias("id"), body.alias("body")).select("id", _hash(F.col("body"), bits).alias("hash"), F.unhex(F.sha2("body", 256)).alias("sha"))


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, entries), all written in the shared folder.

    ``rows`` is (id, hash, sha) of every row. ``entries`` is (bucket, hash, link, keep_id, n, sha): a
    row for each distinct text, with its place in the chain of its hash, its smallest key, its number
    of rows and the SHA-256 by which rows find it. ``bits`` shortens the hash, for tests of chains.
    """
    rows, _ = materialize(_keyed(df, key, text, bits), "copies-rows")
    keys, _ = materialize(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id"), F.min("sha").alias("sha")), "copies-keys")
    slots, _ = materialize(directory(keys, capacity), "copies-directory")

    again = keys.where("n > 1").select("hash")
    body = normalised(F.col(text))
    texts = with_hits(df.select(F.col(key).alias("id"), body.alias("body")).withColumn("hash", _hash(F.col("body"), bits)), F.col("hash"), filter_words(again.select(F.col("hash").alias("name")))).where("_hit")
    # Whole bytes are compared here: copies fold in the task that reads them, then in the one that gathers them.
    compared = texts.groupBy("hash", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    compared = compared.select("hash", "keep_id", "n", F.unhex(F.sha2("body", 256)).alias("sha")).join(again, "hash", "left_semi")
    every = keys.where("n = 1").select("hash", "keep_id", "n", "sha").unionByName(compared)

    top = slots.agg(F.max("depth")).first()[0]
    slot = F.shiftrightunsigned("hash", 64 - top) if top else F.lit(0).cast("long")
    placed = every.withColumn("slot", slot).join(slots.select("slot", "bucket"), "slot").repartitionByRange("bucket")
    chain = Window.partitionBy("bucket", "hash").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    # Two texts of one hash and one SHA-256 would not be told apart by their rows: then the job stops.
    named = F.when(F.lag("sha").over(chain) == F.col("sha"), F.raise_error(F.lit("two different texts have one SHA-256"))).otherwise(F.col("sha"))
    linked = placed.select("bucket", "hash", F.row_number().over(chain).alias("link"), "keep_id", "n", named.alias("sha"))
    entries, _ = materialize(linked.sortWithinPartitions("bucket", "hash", "link"), "copies-index")
    return rows, slots, entries


def mark_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """A row for each row of ``df``: its key, keep_id, group_size, kept and text_sha256."""
    rows, _, entries = build_index(df, key, text, capacity, bits)
    groups = entries.where("n > 1").select("hash", "sha", "keep_id", F.col("n").alias("group_size"))
    hot_rows = rows.count() / HOT_PARTS
    hot, cold = groups.where(F.col("group_size") > hot_rows), groups.where(F.col("group_size") <= hot_rows)
    marked = with_hits(rows, F.col("hash"), filter_words(groups.select(F.col("hash").alias("name"))))
    one = F.lit(1).cast("long")
    alone = marked.where("not _hit").select("id", "sha", F.col("id").alias("keep_id"), one.alias("group_size"))
    # Fewer than HOT_PARTS texts are hot: their entries go to every task, so their rows stay where they are.
    first = marked.where("_hit").drop("_hit").join(F.broadcast(hot), ["hash", "sha"], "left")
    found = first.where("group_size is not null").select("id", "sha", "keep_id", "group_size")
    rest = first.where("group_size is null").select("id", "hash", "sha").join(cold, ["hash", "sha"], "left")
    rest = rest.select("id", "sha", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"))
    out = alone.unionByName(found).unionByName(rest)
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``df`` that stay, whole, each once: of rows equal in key and normalised text, any one."""
    marks = mark_exact_copies(df, key, text, capacity).where("group_size > 1")
    gone = marks.groupBy(F.col(key).alias("_copy_key"), F.col("text_sha256").alias("_copy_sha")).agg(F.min("kept").alias("_copy_kept"), F.count(F.lit(1)).alias("_copy_rows"))
    named = df.withColumn("_copy_own", F.sha2(normalised(F.col(text)), 256))
    joined = named.join(gone, F.col(key).eqNullSafe(F.col("_copy_key")) & (F.col("_copy_own") == F.col("_copy_sha")), "left")
    once = joined.where("_copy_rows > 1 and _copy_kept").dropDuplicates([key, "_copy_own"])
    return joined.where("_copy_rows is null or (_copy_rows = 1 and _copy_kept)").unionByName(once).select(*df.columns)


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_copies(documents(spark, sf_dir))


OP12_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id is not distinct from min(doc_id) over (partition by t) kept, sha256(t) text_sha256
from n
"""
