"""Queries of failures, dispatch, checklists, applications and posting times on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import applications, dispatch, failures, health, timing
from gleaner.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_NOW = 883612800  # 1998-01-01


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_MESSAGES = ("Application LINK broke: https://x.org/schema", "Malformed JSON in pagination", "Suspicious zero-row result", "socket hang up", "row shape", "disk full https://x.org/timeout")


@query(f"""with f as (select event_id, event_type, (json_extract_string(props, '$.k'))::int k from events where event_type = 'error'),
 m as (select *, (list_value{_MESSAGES})[k % 6 + 1] msg, case k % 7 when 0 then 'http' when 1 then 'identity' when 2 then 'empty' when 3 then 'link' end given, case k % 5 when 0 then 429 when 1 then 404 when 2 then 503 end status from f),
 c as (select *, coalesce(given, (['link', 'json', 'quality', 'transport', 'json', 'persistence'])[k % 6 + 1]) cat from m)
 select event_id, cat category, case when status = 429 then 'rate_limited' when status = 404 then 'not_found' when status >= 500 then 'temporary_provider_error' when cat in ('http', 'transport') then 'temporary_provider_error' when cat = 'json' then case when contains(msg, 'pagination') then 'incomplete_pagination' else 'invalid_schema' end
   when cat = 'identity' then 'application_host_mismatch' when cat in ('empty', 'quality') then 'unexpected_raw_zero' when cat = 'persistence' then 'catalog_write_failed' else 'failed' end outcome,
   case cat when 'json' then 'schema' when 'transport' then 'fetch' when 'http' then 'fetch' else cat end failure from c""")
def failure_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.get_json_object("props", "$.k").cast("int"), F.col
    message = F.get(F.array(*map(F.lit, _MESSAGES)), k % 6)
    given = F.when(k % 7 == 0, "http").when(k % 7 == 1, "identity").when(k % 7 == 2, "empty").when(k % 7 == 3, "link")
    status = F.when(k % 5 == 0, 429).when(k % 5 == 1, 404).when(k % 5 == 2, 503)
    told = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", message.alias("message"), status.alias("status"), failures.failure_category(given, message).alias("category"))
    return told.select("event_id", "category", failures.failure_outcome(c("category"), c("status"), c("message")).alias("outcome"), failures.run_failure(c("category")).alias("failure"))


_FNV = "(list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(source_id, ''), lambda c: unicode(c)::hugeint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 6)"


@query(f"""with s as (select (case c_custkey % 4 when 0 then 'lever-' when 1 then 'ashby-' when 2 then 'x-greenhouse-' else 'list-' end) || c_custkey source_id, c_custkey k, case when c_custkey % 3 = 0 then 'published' else 'shadow' end status from customer),
 cp as (select source_id, case when k % 15 <> 10 then {_NOW} - 3600 * (k % 9) end seen from s where k % 5 = 0 and k % 10 < 9 and (k % 20 < 15 or status = 'published')),
 h as (select o_custkey k, max(floor(epoch(o_orderdate)))::bigint ran from orders where o_custkey % 2 = 0 group by 1),
 y as (select s.*, cp.source_id is not null or h.k is not null known, case when h.k is null then seen else coalesce(case when s.k % 7 > 0 then case when s.k % 8 < 5 then {_NOW} - 1800 * (s.k % 11) else ran end end, case when s.k % 9 = 1 then ran end, seen) end last_at,
   h.k is not null and s.k % 11 = 0 paused, case when h.k is not null and s.k % 6 = 0 then {_NOW} + 3600 * (s.k % 5 - 2) end backoff from s left join cp on cp.source_id = s.source_id left join h on h.k = s.k)
 select source_id, status, case when starts_with(source_id, 'ashby-') then 'ashby' when starts_with(source_id, 'lever-') then 'lever' when contains(source_id, 'greenhouse-') then 'greenhouse' else 'github' end provider, case when source_id[:5] in ('ashby', 'lever') then 'global' else 'unknown' end region from y
 where not paused and not coalesce(backoff > {_NOW}, false) and (status = 'published' or case when last_at is not null then {_NOW} // 1800 - last_at // 1800 >= 6 when known then true else ({_NOW} // 1800) % 6 = {_FNV} end)""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, some with checkpoints and those with orders with health; who is polled now."""
    k, c = F.col("c_custkey"), F.col
    name = F.concat(F.when(k % 4 == 0, "lever-").when(k % 4 == 1, "ashby-").when(k % 4 == 2, "x-greenhouse-").otherwise("list-"), k)
    sources = table(spark, sf_dir, "customer").select(name.alias("source_id"), k.alias("k"), F.when(k % 3 == 0, "published").otherwise("shadow").alias("status"))
    k = F.col("k")
    # A shadow source's checkpoint under its plain id is another source's and does not count.
    known = sources.where((k % 5 == 0) & (k % 10 < 9))
    checkpoint = F.when((c("status") == "shadow") & (k % 20 < 15), F.concat(F.lit("shadow-"), "source_id")).otherwise(c("source_id"))
    checkpoints = known.select(checkpoint.alias("source_id"), F.when(k % 15 != 10, F.lit(_NOW) - 3600 * (k % 9)).cast("long").alias("last_success_at"))
    runs = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").groupBy(c("o_custkey").alias("k")).agg(F.max(health.epoch_seconds("o_orderdate")).alias("at"))
    state = runs.join(sources, "k").select(
        "source_id", (k % 11 == 0).alias("paused"), F.when(k % 6 == 0, F.lit(_NOW) + 3600 * (k % 5 - 2)).alias("backoff_until"),
        F.when(k % 7 > 0, F.when(k % 8 < 5, F.lit(_NOW) - 1800 * (k % 11)).otherwise(c("at"))).cast("long").alias("last_attempt_at"), F.when(k % 9 == 1, c("at")).alias("last_success_at"),
    )
    provider = failures.provider_of(c("source_id"))
    return dispatch.due_sources(sources.drop("k"), checkpoints, state, _NOW).select("source_id", "status", provider.alias("provider"), failures.region_of(provider).alias("region"))


@query("""with n as (select l_orderkey + case when l_orderkey % 10 = 0 then 10000000 else 0 end k, max(l_linenumber) event from lineitem where l_linenumber >= 3 group by 1)
 select o_orderkey, 'quiet' part, null::bigint event_id from orders where o_orderkey not in (select k from n) union all select o_orderkey, 'alerting', event from orders join n on k = o_orderkey
 union all select l_orderkey + 10000000, 'orphaned', l_linenumber from lineitem where l_linenumber >= 3 and l_orderkey % 10 = 0""")
def alerting_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a plan, line items as its notifications, some of jobs that are not in it."""
    jobs = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 10 == 0, 10_000_000).otherwise(0)
    notifications = table(spark, sf_dir, "lineitem").where("l_linenumber >= 3").select(key.alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("event_id"))
    quiet, alerting, orphaned = dispatch.split_writes(jobs, notifications, "o_orderkey")
    part = lambda df, name, event: df.select("o_orderkey", F.lit(name).alias("part"), event.alias("event_id"))
    none = F.lit(None).cast("long")
    return part(quiet, "quiet", none).unionByName(part(alerting, "alerting", F.col("notification.event_id"))).unionByName(part(orphaned, "orphaned", F.col("event_id")))


@query("""with d as (select strftime(ts, '%Y-%m-%d') || '/' || user_id % 20 period, list(distinct event_type) done, count(*) filter (event_type = 'error') failed, count(*) filter (event_type = 'click' and value > 50) waiting from events group by 1),
 x as (select *, list_filter(['view', 'click', 'signup', 'audit', 'purchase'], lambda i: not list_contains(done, i)) pending from d), y as (select *, 1 + failed + 2 + case when waiting > 0 then 1 else 0 end signals from x)
 select period, 5 - len(pending) completed, 5 total, len(pending) = 0 complete, array_to_string(pending, ',') pending, len(pending) || ' monitoring checks pending · ' || signals || ' signals need review' reminder from y""")
def monitoring_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of groups of users as periods, kinds of events as checks; one check is never done."""
    c = F.col
    period = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), c("user_id") % 20)
    events = table(spark, sf_dir, "events").withColumn("period", period)
    items = spark.createDataFrame([("signup", 2), ("view", 0), ("purchase", 4), ("audit", 3), ("click", 1)], "event_type string, position int")
    lists = dispatch.checklists(items, events, "period", "event_type")
    counts = events.groupBy("period").agg(F.count_if(c("event_type") == "error").alias("failed"), F.count_if((c("event_type") == "click") & (c("value") > 50)).alias("waiting"))
    signals = dispatch.attention(F.lit(1), c("failed"), F.lit(None).cast("long"), F.lit(2), F.lit(0), c("waiting"))
    return lists.join(counts, "period").select("period", "completed", "total", "complete", F.array_join("pending", ",").alias("pending"), dispatch.reminder(c("pending"), signals).alias("reminder"))


_UUID = "12345678-90ab-4cde-8f01-234567890abc"
_URLS = (
    "https://www.LinkedIn.com/jobs/1", "https://job-boards.greenhouse.io/acme/jobs/1", "https://x.boards.greenhouse.io/a", "https://jobs.lever.co/acme/1/Apply", "https://jobs.lever.co/acme/1", f"https://jobs.ashbyhq.com/Acme/{_UUID}/application",
    f"https://jobs.ashbyhq.com/acme/{_UUID}/application", f"https://jobs.ashbyhq.com/Acme/{_UUID}", "https://job-boards.eu.greenhouse.io/a", "https://notlinkedin.com/", "mailto:x",
)


@query(f"""with a as (select o_orderkey application_id, o_custkey + case when o_orderkey % 6 = 0 then 100000000 else 0 end job_id, o_orderkey % 9 = 0 partner, o_orderkey % 7 status from orders), j as (select c_custkey job_id, c_name title, c_custkey % 11 u from customer)
 select application_id, title, case when title is null then null when partner then 'partner-only' when u in (1, 2, 3, 5, 8) then 'headed-supported' else 'manual-only' end eligibility,
  case when title is null then null when partner then 'partner-submission-requires-employer-authorization' when u = 0 then 'destination-policy-prohibits-automation' when u in (1, 2, 8) then 'greenhouse-headed-pilot' when u = 3 then 'lever-headed-pilot' when u = 5 then 'ashby-headed-pilot' else 'destination-not-reviewed' end reason
 from a left join j using (job_id) where status = 3""")
def application_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications of one status with customers as their jobs, some of which are gone."""
    o, c = F.col("o_orderkey"), F.col
    apps = table(spark, sf_dir, "orders").select(
        o.alias("application_id"), (c("o_custkey") + F.when(o % 6 == 0, 100_000_000).otherwise(0)).alias("job_id"), F.when(o % 9 == 0, "partner").otherwise("official-form").alias("apply_mode"),
        F.get(F.array(*map(F.lit, applications.STATUSES)), (o % 7).cast("int")).alias("status"),
    )
    url = F.get(F.array(*map(F.lit, _URLS)), (c("c_custkey") % 11).cast("int"))
    jobs = table(spark, sf_dir, "customer").select(c("c_custkey").alias("job_id"), c("c_mktsegment").alias("company"), c("c_name").alias("title"), F.lit("").alias("location"), F.lit("").alias("season"), url.alias("apply_url"), F.lit(True).alias("open"))
    out = applications.summaries(apps, jobs, spark.createDataFrame([("Acme",)], "board string"), status=applications.STATUSES[3])
    return out.select("application_id", "job.title", "assistance.eligibility", "assistance.reason")


_TIMED = """with r as (select o_custkey k, o_orderkey o, (['github-x', 'lever-a', 'Ashby-b', 'Greenhouse-c'])[o_orderkey % 4 + 1] source_id, case when o_orderkey % 5 > 0 then case when o_orderkey % 6 = 0 then strftime(o_orderdate, '%d.%m.%Y') when o_orderkey % 6 = 1 then strftime(o_orderdate, '%Y-%m-%dT10:30:00Z') else strftime(o_orderdate, '%Y-%m-%d') end end t, o_orderkey % 3 sem from orders),
 c as (select k, source_id <> 'github-x' official, sem = 0 published, case when sem = 0 then t when source_id = 'github-x' and (sem = 2 or t is null) then (['1996-02-30', '1999-01-05'])[o % 2 + 1] end v from r),
 g as (select k, not (published and official) late, v from c where regexp_matches(v, '^[0-9]{4}-') and v <> '1996-02-30'), f as (select k, min(late) late, arg_min(v, (late, v)) v from g group by 1),
 x as (select c_custkey, coalesce(f.v, case when c_custkey % 4 > 0 then '1997-12-30' end) t, case when not late then 'employer-posted' when late then 'source-reported' when c_custkey % 4 > 0 then 'found' else 'unknown' end kind from customer left join f on f.k = c_custkey)"""


def _times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_orderkey"), F.col
    jobs = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), F.when(c("c_custkey") % 4 > 0, "1997-12-30").otherwise("lately").alias("first_seen_at"))
    date = F.when(o % 6 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(o % 6 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    source = F.get(F.array(*map(F.lit, ("github-x", "lever-a", "Ashby-b", "Greenhouse-c"))), (o % 4).cast("int"))
    given = F.when(o % 5 > 0, date)
    refs = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("k"), o.alias("position"), source.alias("source_id"), F.lit("").alias("source_url"), F.when(o % 2 == 0, "1996-02-30").otherwise("1999-01-05").alias("posted_at"),
        F.when(o % 3 == 2, None).otherwise(given).alias("provider_time"), F.when(o % 3 == 0, "published").when(o % 3 == 1, "updated").alias("semantics"),
    )
    return jobs, refs


@query(f"{_TIMED} select c_custkey k, kind, t as \"timestamp\" from x")
def posting_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs, orders as references: who vouches for the time that a job was posted."""
    return timing.posting_timing(*_times(spark, sf_dir), "k")


@query("""with r as (select o_custkey k, o_orderkey o, (['', 'Lever', 'Ashby', 'Greenhouse'])[o_orderkey % 4 + 1] n from orders), b as (select k, n, min(o) o from r group by 1, 2), g as (select k, string_agg(n, ' + ' order by o) filter (n <> '') names, bool_or(n = '') community from b group by 1)
 select k, case when names is null then 'Community listing' else 'Official employer source · ' || names end primary_text, case when names is not null and community then 'Also corroborated by a community listing' end corroboration from g""")
def source_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.source_text(_times(spark, sf_dir)[1], "k").select("k", F.col("primary").alias("primary_text"), "corroboration")


@query("""select o_orderpriority || ' — ' || 'A & B' || ' (<' || o_orderstatus || chr(62) || ')' || chr(10) || 'https://x.org/' || o_orderkey "text",
 '<li><strong>' || o_orderpriority || '</strong> — A &amp; B (&lt;' || o_orderstatus || '&gt;)<br><a href="https://x.org/' || o_orderkey || '">Apply</a></li>' html from orders where o_orderstatus = 'O' and o_orderkey % 3 = 0""")
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders that wait for a digest, the dearest first."""
    c, key = F.col, F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        c("o_orderpriority").alias("company"), F.lit("A & B").alias("title"), F.concat(F.lit("<"), "o_orderstatus", F.lit(">")).alias("location"), F.concat(F.lit("https://x.org/"), key).alias("apply_url"), (c("o_orderstatus") == "O").alias("open"), (key % 3 == 0).alias("pending"), "o_totalprice", "o_orderkey"
    )
    return applications.digest_lines(jobs, "pending", [c("o_totalprice").desc(), c("o_orderkey")])
