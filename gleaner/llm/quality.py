"""Quality rules: counts within a text, and lines that too many documents of a host share.

Base rules: a text fails with fewer than ``min_words`` words or with more than half of its words
in 3-word windows that occur twice or more. Cross-document rule: lines are normalised (lower case,
digits as 0, white space as one space), hashed and counted by distinct documents of each host; a
line above the host's limit is removed, and a document that keeps too few words is rejected.

Everything is DataFrame functions. Rows of one key are one document to the counts of lines, however
often they are repeated; rows without a key count for no document, but lose lines like others. A null
text has no words and fails; rows without a host are one host of their own. Empty tables give no rows.
Only the columns named are read, so others may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.common import documents

#: White space and symbols of the counts.
SPACE = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"
#: Window positions share a 64-bit integer with 44 bits of hash. Texts with more words, or with two
#: different windows of one hash, sort the windows themselves instead.
POSITION_BITS = 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _same_window(words: Column, i: Column, j: Column) -> Column:
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def _repeated(windows: Column, name, position) -> Column:
    """Ascending starts of the windows whose name occurs twice or more; ``windows`` is sorted by name."""
    twice = F.filter(windows, lambda x, k: (name(x) == name(F.get(windows, k + 1))) | (name(x) == name(F.get(windows, k - 1))))
    return F.array_sort(F.transform(twice, position))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": words_of(body), "_lines": lines_of(body), "n_symbols": F.length(F.regexp_replace(body, NO_SYMBOL, "")).cast("long")})
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    w = F.col("_words")
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed, mask = F.col("_packed"), (1 << POSITION_BITS) - 1
    bucket, place = lambda x: F.shiftright(x, POSITION_BITS), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    short = F.when(F.col("n_words") < 1 << POSITION_BITS, F.sort_array(F.transform(starts, lambda i: F.shiftleft(hashed(i), POSITION_BITS).bitwiseOR(i.cast("long")))))
    # Sorted neighbours of one bucket that differ show every bucket that holds more than one window.
    mixed = F.size(F.filter(packed, lambda x, k: (bucket(x) == bucket(F.get(packed, k + 1))) & ~_same_window(w, place(x), place(F.get(packed, k + 1))))) > 0
    df = df.withColumn("_packed", short).withColumn("_plain", packed.isNull() | mixed)
    named = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("name"), i.alias("i"))))
    df = df.withColumn("_named", F.when(F.col("_plain"), named))
    df = df.withColumn("_again", F.when(F.col("_plain"), _repeated(F.col("_named"), lambda x: x["name"], lambda x: x["i"])).otherwise(_repeated(packed, bucket, place)))
    again = F.col("_again")
    covered = F.aggregate(F.transform(again, lambda x, k: F.least(F.get(again, k + 1) - x, F.lit(3))), F.lit(0), lambda a, b: a + b)
    return df.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("_words", "_lines", "_packed", "_plain", "_named", "_again")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def frequent_lines(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", least: int = 20, share: float = 0.01) -> DataFrame:
    """(host, line): hashes of the lines that more distinct documents of the host hold than its limit.

    The limit is the larger of ``least`` documents and ``share`` of the host's documents. Rows are
    counted first, by partial sums; only lines in enough rows are counted by distinct documents.
    """
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    lines = rows.select("id", "host", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(normalised(x))))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > least)
    hosts = rows.groupBy("host").agg(F.count_distinct("id").alias("host_docs"))
    often = often.join(hosts, "host").where(F.col("n_rows") > share * F.col("host_docs"))
    docs = lines.join(often.select("host", "line", "host_docs"), ["host", "line"]).groupBy("host", "line").agg(F.count_distinct("id").alias("n_docs"), F.max("host_docs").alias("host_docs"))
    return docs.where((F.col("n_docs") > least) & (F.col("n_docs") > share * F.col("host_docs"))).select("host", "line")


def _line_rows(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """A row for each line that holds a word, with its document's key and its place there."""
    body = F.col(text)
    return df.select(F.col(key).alias("id"), F.xxhash64(body).alias("text_hash"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.posexplode(F.split(body, "\n")).alias("place", "raw")).where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))


def apply_quality_rules(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_words: int = 50, most_repeated: int = 50, least: int = 20, share: float = 0.01, depleted: float = 0.3) -> DataFrame:
    """A row for each document: its counts, words in removed lines, base_failed and kept.

    A document is depleted when the words that stay are fewer than ``min_words`` or than the share
    ``depleted`` of its words.
    """
    base = with_counts(df.select(F.col(key).alias("id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("_text")), "_text").drop("_text")
    lines = _line_rows(df, key, host, text).select("id", "text_hash", "host", "place", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(words_of(F.col("raw"))).alias("words"))
    removed = lines.join(frequent_lines(df, key, host, text, least, share), ["host", "line"], "left_semi")
    removed = removed.groupBy("id", "text_hash", "host", "place").agg(F.max("words").alias("words")).groupBy("id", "text_hash", "host").agg(F.sum("words").alias("removed_words"))
    removed = removed.select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.col("host").alias("r_host"), "removed_words")
    out = base.join(removed, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("host") == F.col("r_host")), "left")
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stay = F.col("n_words") - gone
    kept = ~failed & ((gone == 0) | ((stay >= min_words) & (stay >= depleted * F.col("n_words"))))
    return out.select(F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), gone.cast("long").alias("n_removed_words"))


def remove_frequent_lines(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", least: int = 20, share: float = 0.01) -> DataFrame:
    """``df`` with the lines above their host's limit taken out of the text.

    A document's lines are put together again from rows of their own; texts without such lines
    pass as they are. Null texts stay null.
    """
    bad = frequent_lines(df, key, host, text, least, share)
    lines = _line_rows(df, key, host, text).select("id", "text_hash", "host", "place", F.xxhash64(normalised(F.col("raw"))).alias("line"))
    marks = lines.join(bad, ["host", "line"], "left_semi").groupBy("id", "text_hash", "host").agg(F.collect_set("place").alias("_gone"))
    marks = marks.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"), "_gone")
    on = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_hash")) & (F.coalesce(F.col(host), F.lit("")) == F.col("_host"))
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    joined = df.join(marks, on, "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(*df.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(documents(spark, sf_dir))


OP9_SQL = r"""
with base as (
  select row_number() over () r, doc_id, coalesce(source, '') host, coalesce(text, '') body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from documents),
win as (
  select r, unnest(range(1, len(w) - 1)) i, w from base where len(w) >= 3),
seen as (
  select r, i, count(*) over (partition by r, w[i], w[i+1], w[i+2]) n from win),
rep as (
  select r, count(distinct p) n from (select r, unnest([i, i+1, i+2]) p from seen where n >= 2) group by 1),
lines as (
  select r, doc_id, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') line,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) words
  from (select r, doc_id, host, unnest(ls) x from base)),
bad as (
  select l.host, l.line from lines l group by 1, 2
  having count(distinct doc_id) > greatest(20, 0.01 * (select count(distinct doc_id) from base b where b.host = l.host))),
gone as (
  select r, sum(words) n from lines semi join bad using (host, line) group by 1),
f as (
  select b.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(g.n, 0)::bigint n_removed_words
  from base b left join rep using (r) left join gone g using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and (n_removed_words = 0 or (n_words - n_removed_words >= 50 and n_words - n_removed_words >= 0.3 * n_words)) as kept
from f
"""
