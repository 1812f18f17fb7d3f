"""Queries on documents, pages, labels and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import hashing, season, text as t, url as u
from gleaner.operators import classify, identity, ledger
from gleaner.plans.tables import AGGREGATORS, NOW, SUFFIXES, WORDS, page_titles, postings, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _words(p: str) -> str:
    return rf"\b(?:{p})\b"


_SCORED = rf"""
scored as (
  select *, len(list_distinct(regexp_extract_all(lower(body), '{_words(WORDS.strong)}')))::int "domain",
    len(list_distinct(regexp_extract_all(lower(body), '{_words(WORDS.stack)}')))::int stack,
    len(list_distinct(regexp_extract_all(lower(body), '{_words(WORDS.business)}')))::int business
  from (select doc_id, source, coalesce(text, '') body from documents)),
points as (select *, (least("domain", 3) * 3 + least(stack, 6) - 2 * business)::int score from scored)"""
_DECIDED = rf"""{_SCORED},
decided as (
  select doc_id, source, case when not regexp_matches(body, '(?i){_words(WORDS.lifecycle)}') then 'filtered'
    when regexp_matches(body, '(?i){_words(WORDS.strong)}') then 'included'
    when regexp_matches(body, '(?i){_words(WORDS.business)}') then 'shelved'
    when regexp_matches(body, '(?i){_words("|".join(WORDS.categories.values()))}') then 'included'
    when trim(body) <> '' and score >= 4 and stack >= 2 then 'included' else 'shelved' end outcome
  from points)"""


@query(f"""with {_DECIDED} select source as source_id, count(*)::bigint valid, count(*) filter (outcome = 'included')::bigint eligible,
  count(*) filter (outcome = 'shelved')::bigint shelved, count(*) filter (outcome = 'filtered')::bigint filtered, 0::bigint withheld from decided group by 1""")
def snapshot_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.decision_counts(classify.decide(postings(spark, sf_dir), WORDS, AGGREGATORS))


@query(f"with {_SCORED} select doc_id, \"domain\", stack, business, score, score >= 4 and stack >= 2 as technical from points")
def technical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    out = table(spark, sf_dir, "documents").select("doc_id", *(v.cast("int").alias(k) for k, v in classify.technical_score(body, WORDS).items()))
    return out.withColumn("technical", (F.col("score") >= 4) & (F.col("stack") >= 2))


@query("select doc_id, concat_ws(',', " + ", ".join(rf"case when regexp_matches(coalesce(text, ''), '(?i){_words(p)}') then '{k}' end" for k, p in WORDS.categories.items()) + ") as categories from documents")
def classify_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.classify(F.coalesce(F.col("text"), F.lit("")), WORDS.categories), ",").alias("categories"))


@query("select doc_id, sha256(concat_ws('|', coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) as fingerprint from documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


@query("with h as (select source, sha256(concat_ws('|', doc_id::varchar, coalesce(text, ''))) d from documents) select source, " + ", ".join(f"sum(('0x' || substr(d, {8 * k + 1}, 8))::bigint)::bigint hash_{k}" for k in range(4)) + " from h group by 1")
def snapshot_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(*hashing.content_hash(F.col("doc_id"), F.col("text")))


@query("select min(doc_id) doc_id, arg_min(source, doc_id) source, sha256(coalesce(text, '')) as text_hash, count(*)::bigint copies from documents group by 3")
def exact_duplicate_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", hashing.fingerprint(F.col("text")).alias("text_hash"))
    return identity.keep_first(rows, ["text_hash"], "doc_id")


@query("""with stored as (select url, sha256(coalesce(html, '')) h, page_id from pages),
by_url as (select url, min(page_id) i from stored where url is not null group by 1), by_hash as (select h, min(page_id) i from stored group by 1)
select page_id, coalesce(a.i, b.i) as job, case when a.i is not null then 'url' else 'hash' end as matched_by
from stored s left join by_url a on a.url = s.url left join by_hash b on b.h = s.h""")
def identity_resolution_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", hashing.fingerprint(F.col("html")).alias("hash"))
    return identity.resolve(rows, rows.withColumnRenamed("page_id", "job"), ["url", "hash"], "job").select("page_id", "job", "matched_by")


@query("""select page_id, case when regexp_matches(trim(url), '^(?i)https?://') then regexp_replace(
  lower(regexp_extract(trim(url), '^(?i)(https?)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(trim(url), '^(?i)(https?)://([^/?#]*)', 2))
  || case when regexp_extract(trim(url), '^(?i)https?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(trim(url), '^(?i)https?://[^/?#]*([^?#]*)', 1) end
  || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end, '/$', '') end as normalized
from (select page_id, url, list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> ''
  and not regexp_matches(lower(string_split(p, '=')[1]), '^(fbclid|gclid|mc_cid|mc_eid|ref|source|utm_.*)$'))) q from pages)""".replace("\\\\", "\\"))
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", u.normalize_url(F.col("url")).alias("normalized"))


_HOST = "lower(regexp_extract(trim(url), '^(?i)https?://([^/?#:]*)', 1))"


@query(f"""select page_id, case when url is null or {_HOST} = '' then 'invalid' when not regexp_matches(trim(url), '^(?i)https:') then 'not-https'
  when {_HOST} in ({", ".join(f"'{x}'" for x in AGGREGATORS)}) then 'aggregator' end as rejection from pages""")
def url_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", u.url_rejection(F.col("url"), AGGREGATORS).alias("rejection"))


@query(f"select page_id, {_HOST} = 'example.com' or ends_with({_HOST}, '.example.com') as allowed from pages")
def host_allowlist_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", u.host_allowed(u.host(F.col("url")), ["example.com"]).alias("allowed"))


@query(f"select page_id, regexp_extract({_HOST}, '([^.]*\\.)?[^.]*$', 0) as domain from pages".replace("\\\\", "\\"))
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", u.registrable_domain(u.host(F.col("url")), SUFFIXES).alias("domain"))


def _decoded(x: str) -> str:
    for name in [*(k for k in t.ENTITIES if k != "&amp;"), "&amp;"]:
        x = f"regexp_replace({x}, '{name}', '{t.ENTITIES[name].replace(chr(39), chr(39) * 2)}', 'gi')"
    return x


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


@query("select page_id, " + _collapsed(f"regexp_replace({_decoded("coalesce(html, '')")}, '<[^>]+>', ' ', 'g')") + " as body from pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.html_to_text(F.col("html")).alias("body"))


_DROPPED = "coalesce(html, '')"
for _tag in ("script", "style", "svg"):
    _DROPPED = rf"regexp_replace({_DROPPED}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"


@query("select page_id, " + _collapsed(_decoded(f"regexp_replace({_DROPPED}, '<[^>]+>', ' ', 'g')")) + " as body from pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.page_text(F.col("html")).alias("body"))


@query(f"""with h as (select {_HOST} host, regexp_extract({_HOST}, '([^.]*\\.)?[^.]*$', 0) source from pages), c as (select source, host, count(*) n from h group by 1, 2)
select source, sum(n)::bigint n_rows, count(*)::bigint n_keys, max(n)::bigint largest, max(n) > 0.05 * sum(n) as too_concentrated from c group by 1""".replace("\\\\", "\\"))
def host_concentration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = u.host(F.col("url"))
    return ledger.concentration(table(spark, sf_dir, "pages").select(u.registrable_domain(name, SUFFIXES).alias("source"), name.alias("host")), "source", "host", 0.05)


@query("select doc_id, quality, toxic, l.doc_id is not null as labelled from documents d left join (select doc_id, max(quality) quality, max(toxic) toxic from labels group by 1) l using (doc_id)".replace("l.doc_id is not null", "(quality is not null or toxic is not null)"))
def label_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").withColumn("labelled", F.col("quality").isNotNull() | F.col("toxic").isNotNull())


@query("select source, case count(distinct lang) when 0 then 'Job board' when 1 then min(lang) else 'Official careers site' end as label from documents group by 1")
def reference_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("lang")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(n == 0, "Job board").when(n == 1, F.min("lang")).otherwise("Official careers site").alias("label"))


@query('select quality, count(*) filter (toxic = 0)::bigint as "clean", count(*) filter (toxic = 1)::bigint as "toxic" from labels group by 1')
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    return out.select("quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("""select conv_id, turn, last_value(case when text not like '%.%.%' and role <> '' then role end ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and current row) as carried from conversations""")
def carry_forward_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "conversations").withColumn("named", F.when(~F.col("text").like("%.%.%"), F.col("role")))
    return ledger.carry_forward(named, "conv_id", "turn", "named").select("conv_id", "turn", "carried")


@query("select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))), ' ') as title from part")
def canonical_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.canonical_title(F.col("p_name")).alias("title"))


@query(rf"""select doc_id, season, case when regexp_matches(season, '^\d+$') then season::int < {NOW.year} else false end as past from (
  select doc_id, coalesce(list_filter(regexp_extract_all(coalesce(text, ''), '\b(20\d\d)\b', 1), lambda y: y::int between {NOW.year} and {NOW.year + 3})[1], 'ongoing') season from documents)""")
def season_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", season.infer_season(F.coalesce(F.col("text"), F.lit("")), NOW).alias("season"))
    return out.withColumn("past", season.is_past_season(F.col("season"), NOW))


@query("select distinct source, (list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(coalesce(source, ''), ''), lambda c: unicode(c)::hugeint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 6)::bigint as bucket from documents")
def shadow_bucket_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", hashing.fnv_bucket(F.coalesce(F.col("source"), F.lit("")), 6).alias("bucket"))
