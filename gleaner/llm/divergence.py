"""How far the sources of a language are from each other and from their language, by their words.

Terms are stretches of letters (all characters beyond ASCII count as letters), A-Z in lower case; a
language keeps those in at least ``least_docs`` of its documents. A group of N kept words gives a
term that it holds n times p = 1 + floor(10^9 (n + 1) / (N + V)), V being the language's number of
kept terms, and the distance of two such shares is floor((p - q)^2 / q).

Each task turns its texts into counts; these are hashed by language and term to shards, where DuckDB
adds them up and keeps the common terms. With N and V known, shards of terms give partial sums for
pairs of sources: what a pair gains over two sources that hold no term, term by term only where both
hold it, by distinct counts where one does. Spark adds the partial sums up and ranks. All arithmetic
is on integers.

Null text, language and source are ''. A group without terms is a group; a language without kept
terms has value 0 for all its pairs. Repeated rows are documents of their own. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from gleaner.llm.common import TEXT_ROWS, dealt, documents, materialize, trimmed

#: Bytes of text that are counted together, unless one text is longer.
GROUP_BYTES = 8_000_000
#: Counts that a shard of terms holds, about.
SHARD_COUNTS = 250_000
SCALE = 1_000_000_000
#: Bytes as terms see them: white space for what is no letter, A-Z in lower case.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_con = None


def _duckdb():
    """A connection that a worker keeps: one thread, and nothing on local disks."""
    global _con
    if _con is None:
        import duckdb

        _con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        _con.execute("create macro far(p, q) as ((p - q) * (p - q)) // q")
    return _con


def _query(sql: str, schema: pa.Schema, **tables) -> list[pa.RecordBatch]:
    con = _duckdb()
    for name, table in tables.items():
        con.register(name, table)
    try:
        found = con.execute(sql).to_arrow_table()
        return found.cast(schema).to_batches(max_chunksize=100_000)
    finally:
        for name in tables:
            con.unregister(name)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNT_SQL = """
select lang, source, term, n, docs
from (select g, t, sum(n)::bigint n, count(*)::bigint docs from (select d, t, count(*) n from words group by d, t) join placed using (d) group by g, t)
join named using (g) join terms using (t)
"""


def _count(rows: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Counts of the terms of (lang, source, text) rows, by group."""
    lang, source, text = (pc.fill_null(c, "") for c in rows.columns)
    body = pa.concat_arrays([text]).cast(pa.large_string())
    _, offsets, data = body.buffers()
    if data is None or not data.size:
        return []
    letters = _LETTERS[np.frombuffer(data, np.uint8)]
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(body), offsets, pa.py_buffer(letters), offset=body.offset))
    words = split.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    cuts = np.append(0, np.cumsum(real))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    seen = words.filter(pa.array(real)).dictionary_encode()
    keys = pa.table({"lang": lang, "source": source, "d": np.arange(len(lang), dtype=np.int32)})
    groups = keys.group_by(["lang", "source"]).aggregate([("d", "list")])
    of = np.empty(len(lang), np.int32)
    for g, held in enumerate(groups["d_list"].to_pylist()):
        of[held] = g
    return _query(
        _COUNT_SQL,
        _COUNTED,
        words=pa.table({"d": np.repeat(np.arange(len(lang), dtype=np.int32), np.diff(cuts)), "t": seen.indices}),
        placed=pa.table({"d": keys["d"], "g": of}),
        named=pa.table({"g": np.arange(len(groups), dtype=np.int32), "lang": groups["lang"], "source": groups["source"]}),
        terms=pa.table({"t": np.arange(len(seen.dictionary), dtype=np.int32), "term": seen.dictionary}),
    )


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts that are still to be added up."""

    def run(batches):
        for batch in batches:
            begin = size = 0
            sizes = pc.binary_length(batch.column(2)).fill_null(0).to_pylist()
            for i, n in enumerate(sizes):
                size += n
                if size >= GROUP_BYTES or i == len(sizes) - 1:
                    yield from _count(batch.slice(begin, i + 1 - begin))
                    begin, size = i + 1, 0

    rows = df.select(*(F.col(c).cast("string") for c in (lang, source, text)))
    return rows.mapInArrow(trimmed(run, 4 * TEXT_ROWS), "lang string, source string, term string, n long, docs long")


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_KEPT_SQL = """
select lang, term, sum(n)::bigint total, list(source order by source) sources, list(n order by source) counts
from (select lang, term, source, sum(n)::bigint n, sum(docs) docs from parts group by all)
group by all having sum(docs) >= {least}
"""


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, total, sources, counts) of the terms in enough documents of a language, a row for each."""

    def run(batches):
        yield from _query(_KEPT_SQL.format(least=int(least_docs)), _KEPT, parts=pa.RecordBatchReader.from_batches(_COUNTED, (b.cast(_COUNTED) for b in batches)))

    return dealt(counts, "lang", "term").mapInArrow(trimmed(run), "lang string, term string, total long, sources array<string>, counts array<long>")


_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])
_SHARD_SQL = """
with g as (select source, n_source + v as of, n_lang + v as of_all, 1 + {scale} // (n_source + v) as p0 from groups_),
c as (select term, total, unnest(sources) source, unnest(counts) n from terms_),
p as (select term, source, p0, (1 + {scale}::hugeint * (n + 1) // of)::bigint p, (1 + {scale}::hugeint * (total + 1) // of_all)::bigint q from c join g using (source)),
held as (select source, p0, p, count(*) k from p group by all),
pairs as (
  select a.source, b.source item, sum(far(a.p, b.p) - far(a.p, b.p0) - far(a.p0, b.p) + far(a.p0, b.p0)) v from p a join p b on a.term = b.term and a.source <> b.source group by all
  union all select h.source, g.source, sum(k::hugeint * (far(h.p, g.p0) - far(h.p0, g.p0))) from held h join g on h.source <> g.source group by all
  union all select g.source, h.source, sum(k::hugeint * (far(g.p0, h.p) - far(g.p0, h.p0))) from held h join g on h.source <> g.source group by all),
top as (select source, term item, far(p, q) v from p where p > q qualify row_number() over (partition by source order by far(p, q) desc, term) <= {most})
select '' lang, source, 'pair' part, item, sum(v)::decimal(38,0) "value" from pairs group by all
union all select '', source, 'term', item, v::decimal(38,0) from top
"""


def _shard_parts(most: int):
    sql = _SHARD_SQL.format(scale=SCALE, most=int(most))

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        if not terms.num_rows:
            return _PART.empty_table()
        found = pa.Table.from_batches(_query(sql, _PART, terms_=terms, groups_=groups), _PART)
        return found.set_column(0, _PART.field(0), pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    return run


def source_divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source.

    Part ``pair``: every other source of the language with its distance, all ranks. Part ``term``: the
    terms that the group holds more often than the language, up to rank ``most_terms``. Ranks count
    from 1 by value, largest first, then by the item's UTF-8 bytes.
    """
    spark = df.sparkSession
    terms, _ = materialize(kept_terms(term_counts(df, lang, source, text), least_docs), "divergence-terms")

    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sizes = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n_source"), F.count(F.lit(1)).alias("held"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("v"), F.sum(F.size("sources")).alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = df.select(word(lang).alias("lang"), word(source).alias("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups, _ = materialize(groups.select("lang", "source", *(zero(c) for c in ("n_source", "n_lang", "v", "rows"))), "divergence-groups")

    # Shards of a language hold about as many counts each: all machines get some, and no shard grows with the input.
    total = langs.agg(F.sum("rows")).first()[0] or 0
    each = min(SHARD_COUNTS, max(1000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    shards = (1 + F.call_function("floor", F.col("rows") / each)).cast("long")
    cut = langs.select(F.col("lang").alias("cut_lang"), shards.alias("shards"))
    left = terms.join(cut, F.col("lang") == F.col("cut_lang")).select("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), "term", "total", "sources", "counts")
    right = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"), "source", "n_source", "n_lang", "v")
    parts = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(_shard_parts(most_terms), "lang string, source string, part string, item string, value decimal(38,0)")
    parts, _ = materialize(parts, "divergence-parts")

    own = groups.select("lang", "source", "v", F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div (n_source + v)")).alias("p"))
    other = own.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("p").alias("q"))
    far = F.expr("case when v = 0 then 0 else (p - q) * (p - q) div q end").cast("decimal(19,0)")
    base = own.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item")))
    base = base.select("lang", "source", "item", (far * F.col("v").cast("decimal(19,0)")).cast("decimal(38,0)").alias("value"))
    pairs = parts.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(base).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    tops = parts.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(tops.select(*pairs.columns)).withColumn("value", F.col("value").cast("long"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP11_SQL = r"""
with d as (
  select row_number() over () d, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents),
w as (select d, lang, source, unnest(w) term from d),
k as (select lang, term, count(*) total from w group by all having count(distinct d) >= 3),
c as (select lang, source, term, count(*) n from w semi join k using (lang, term) group by all),
v as (select lang, count(*) v, sum(total)::bigint n_lang from k group by all),
s as (select lang, source, sum(n)::bigint n_source from c group by all),
g as (
  select lang, source, coalesce(n_source, 0) n_source, coalesce(v, 0) v, coalesce(n_lang, 0) n_lang
  from (select distinct lang, source from d) left join s using (lang, source) left join v using (lang)),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n_source + g.v) p,
    1 + (1000000000::hugeint * (k.total + 1)) // (g.n_lang + g.v) q
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value"
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, "value", row_number() over (partition by lang, source, part order by "value" desc, item)::int rank
from every qualify part = 'pair' or rank <= 200
"""
