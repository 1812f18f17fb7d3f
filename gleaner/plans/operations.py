"""Queries of gates, delivery, catalog reads and registries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import times
from gleaner.operators import delivery, gates, health, identity, ledger, reads, reconcile
from gleaner.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_FAILS = """fails as (select event_id, user_id, ts, floor(epoch(ts))::bigint sec, event_type = 'error' failed, (json_extract_string(props, '$.k'))::int k from events),
 kinds as (select *, case when k < 15 then 'transport' when k < 55 then 'http' when k < 70 then 'identity' when k < 85 then 'quality' else 'empty' end category,
   case when k between 15 and 24 then 429 when k between 25 and 34 then 503 when k between 35 and 54 then 404 end status from fails)"""


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    category = F.when(k < 15, "transport").when(k < 55, "http").when(k < 70, "identity").when(k < 85, "quality").otherwise("empty")
    status = F.when(k.between(15, 24), 429).when(k.between(25, 34), 503).when(k.between(35, 54), 404)
    return table(spark, sf_dir, "events").withColumns({"failed": F.col("event_type") == "error", "at": health.epoch_seconds("ts"), "category": category, "status": status})


_STREAKS = f"{_FAILS}, islands as (select *, count(*) filter (not failed) over (partition by user_id order by ts, event_id) island from kinds), streaks as (select *, count(*) filter (failed) over (partition by user_id, island order by ts, event_id) streak from islands)"
_QUARANTINE = "(category = 'identity' or (category = 'http' and coalesce(status in (401, 403, 404), false)) or (category in ('quality', 'link', 'empty') and streak >= 2))"


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.with_streak(_failures(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("failed"))


@query(f"with {_STREAKS} select event_id, coalesce(category = 'transport' or status = 429 or status between 500 and 599, false) retry, {_QUARANTINE} quarantine from streaks where failed")
def retry_and_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("category"), F.col("status")
    return _streaks(spark, sf_dir).where("failed").select("event_id", gates.retryable(c, s).alias("retry"), gates.quarantined(c, s, F.col("streak")).alias("quarantine"))


_STATES = f"""{_STREAKS}, last as (select user_id, arg_max(streak, (ts, event_id)) failures, bool_or(failed and {_QUARANTINE} and k > 90) quarantined, max(sec) filter (not failed) ok_at, arg_max_null(case when k % 10 = 0 then 'degraded' end, (ts, event_id)) stored, count(*) filter (k % 2 = 0) > 10 active from streaks group by 1),
 states as (select user_id, failures::bigint failures, case when quarantined then 'quarantined' when ok_at is null then coalesce(stored, 'never-succeeded') when coalesce(stored = 'degraded', false) or (1706659200 - ok_at) / 60 > (case when active then 90 else 420 end) then 'degraded' else 'healthy' end state from last)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("failed") & gates.quarantined(F.col("category"), F.col("status"), F.col("streak")) & (k > 90)
    order = F.struct("ts", "event_id")
    last = _streaks(spark, sf_dir).groupBy("user_id").agg(F.max_by("streak", order).alias("failures"), F.bool_or(bad).alias("bad"), F.max(F.when(~F.col("failed"), F.col("at"))).alias("ok_at"), F.max_by(F.struct(F.when(k % 10 == 0, "degraded").alias("s")), order)["s"].alias("stored"), (F.count_if(k % 2 == 0) > 10).alias("active"))
    return last.select("user_id", "failures", gates.state_for(F.col("bad"), F.col("ok_at"), F.col("stored"), (1706659200 - F.col("ok_at")) / 60, F.col("active")).alias("state"))


@query(f"with {_STATES} select * from states")
def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query(f"with {_STATES} select user_id, state, failures from states order by case state when 'quarantined' then 0 when 'degraded' then 1 when 'never-succeeded' then 2 else 3 end, failures desc, user_id limit 100")
def reliability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 sources of the report are the feature."""
    return _states(spark, sf_dir).orderBy(gates.state_rank(F.col("state")), F.desc("failures"), "user_id").limit(100).select("user_id", "state", "failures")


_CATALOG = "catalog as (select o_orderkey, o_orderdate, case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'held' end status, case when o_custkey % 7 = 0 then null else o_custkey % 3 <> 0 end technical, o_orderdate < timestamp '1994-01-01' past, c_mktsegment = 'BUILDING' direct, c_acctbal > 0 community, lower(concat_ws(' ', c_name, c_mktsegment, o_orderpriority)) search, c_nationkey from orders join customer on o_custkey = c_custkey)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey", "c_nationkey", F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("held").alias("status"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 3 != 0).alias("technical"), (F.col("o_orderdate") < "1994-01-01").alias("past"), (F.col("c_mktsegment") == "BUILDING").alias("direct"), (F.col("c_acctbal") > 0).alias("community"), reads.search_text(F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderpriority")).alias("search"))


@query(f"with {_CATALOG} select o_orderkey, search from catalog where status = 'open' and coalesce(technical, true) and not past and direct and community and contains(search, 'building 2')")
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = reads.source_classes(F.col("direct"), F.col("community"))
    return reads.listed(_catalog(spark, sf_dir), "open", F.col("technical"), F.col("past"), classes, "corroborated", F.col("search"), "Building 2").select("o_orderkey", "search")


@query(f"with {_CATALOG} select o_orderkey, array_to_string(list_filter(['all', case when direct then 'direct' end, case when community then 'community' end, case when direct and community then 'corroborated' end], lambda x: x is not null), ',') as classes, concat_ws('#', case when past then '1' else '3' end, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderkey::varchar) as sort_key from catalog")
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array_join(reads.source_classes(F.col("direct"), F.col("community")), ",")
    return _catalog(spark, sf_dir).select("o_orderkey", classes.alias("classes"), reads.open_sort_key(F.col("past"), F.col("o_orderdate"), F.col("o_orderkey")).alias("sort_key"))


@query(f"with {_CATALOG} select o_orderkey from catalog where status = 'closed' order by o_orderdate desc, o_orderkey desc limit 50")
def closed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 is the feature."""
    return reads.page(_catalog(spark, sf_dir).where("status = 'closed'"), [("o_orderdate", True), ("o_orderkey", True)], 50).select("o_orderkey")


@query(f"with {_CATALOG} select o_orderkey, (select count(*) from catalog where status = 'held')::bigint total, (select count(*) from catalog where status = 'held') > 50 has_more from catalog where status = 'held' order by o_orderdate desc, o_orderkey desc limit 50")
def inbox_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 with the total are the feature."""
    held = reads.inbox(_catalog(spark, sf_dir).where("status = 'held'"), [("o_orderdate", True), ("o_orderkey", True)])
    return held.select("o_orderkey", F.col("total").cast("long").alias("total"), "has_more")


@query("select o_orderkey, 0 as part from orders where o_orderpriority = '1-URGENT' union all select o_orderkey, 1 from orders where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'")
def inbox_and_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return reads.inbox_then_feed(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey")


@query("select o_custkey, o_orderkey, nth::int nth, case when nth <= 5 then 'single' else 'chunk' end bucket from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) nth from orders) where nth <= 10")
def alert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten alerts of a run are the feature."""
    return delivery.alert_buckets(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "nth", "bucket")


@query(f"""with {_FAILS} select k.event_id, case when o_orderkey is null or c_custkey is null or s_suppkey is null or k.k % 5 >= 3 then 'error' else 'retry' end outcome
  from kinds k left join orders on o_orderkey = k.event_id left join customer on c_custkey = o_custkey left join supplier on s_suppkey = k.user_id where failed""")
def receipts_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _failures(spark, sf_dir).where("failed").withColumn("attempts", F.get_json_object("props", "$.k").cast("int") % 5)
    joined = failed.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("event_id"), "left").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("user_id"), "left")
    return joined.select("event_id", delivery.retry_outcome(F.col("attempts"), F.col("o_orderkey"), F.col("c_custkey"), F.col("s_suppkey")).alias("outcome"))


_RESULT = "case event_type when 'signup' then 'ok' when 'purchase' then 'ok' when 'error' then 'DeviceNotRegistered' when 'click' then 'RateExceeded' end"


@query(f"""with t as (select event_id, {_RESULT} result from events where event_type <> 'view')
 select o_orderkey, case when result is null then 'pending' when result = 'ok' then 'ok' when result = 'DeviceNotRegistered' or coalesce(nullif(o_custkey % 5, 0), 1) >= 3 then 'error' else 'retryable' end status, coalesce(result = 'DeviceNotRegistered', false) deactivated from orders left join t on event_id = o_orderkey""")
def receipts_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    result = F.when(kind.isin("signup", "purchase"), "ok").when(kind == "error", "DeviceNotRegistered").when(kind == "click", "RateExceeded")
    tickets = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_id").alias("o_orderkey"), result.alias("result"))
    receipts = table(spark, sf_dir, "orders").withColumn("attempts", F.nullif(F.col("o_custkey") % 5, F.lit(0)))
    return delivery.settle(receipts, tickets, "o_orderkey").select("o_orderkey", "status", "deactivated")


@query("select o_orderkey, o_orderstatus = 'O' and o_custkey not in (select user_id from events where event_type = 'purchase') pending from orders")
def digest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").withColumn("pending", F.col("o_orderstatus") == "O")
    return delivery.marked(rows, "pending", sent, "o_custkey").select("o_orderkey", "pending")


_QUALITY = """hosts as (select c_nationkey, o_orderpriority, count(*) n, count(*) filter (o_orderstatus = 'O') o from orders join customer on o_custkey = c_custkey group by 1, 2),
 sums as (select c_nationkey, sum(n)::bigint n_rows, sum(o)::bigint n_open, count(*)::bigint n_hosts, max(n) / sum(n) as share from hosts group by 1)"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return gates.quality_report(rows, "c_nationkey", "o_orderpriority", F.col("o_orderstatus") == "O")


@query(f"with {_QUALITY} select * from sums")
def source_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@query(f"""with {_QUALITY}, j as (select n_nationkey, coalesce(n_rows, 0) n, coalesce(n_hosts, 0) h, coalesce(share, 0) s, case when n_regionkey = 0 then 5 else 1 end least, case when n_regionkey = 0 then 0.25 else 1.0 end most, n_nationkey % 4 = 0 dormant from nation left join sums on c_nationkey = n_nationkey)
 select n_nationkey, array_to_string(list_filter([case when n = 0 and not dormant then 'zero-rows' end, case when n > 0 and h < least then 'few-hosts' end, case when n > 0 and s > most then 'one-host' end], lambda x: x is not null), ',') as failures from j""")
def source_quality_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    policies = nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(5).alias("least_hosts"), F.lit(0.25).alias("most_share"))
    sources = gates.with_policy(nation.withColumnRenamed("n_nationkey", "c_nationkey"), policies, "c_nationkey").join(_quality(spark, sf_dir), "c_nationkey", "left").fillna(0, ["n_rows", "n_hosts", "share"])
    failures = gates.quality_failures(F.col("n_rows"), F.lit(1), F.col("n_hosts"), F.col("share"), F.col("least_hosts"), F.col("most_share"), F.col("c_nationkey") % 4 == 0)
    return sources.select(F.col("c_nationkey").alias("n_nationkey"), F.array_join(failures, ",").alias("failures"))


@query("select user_id, count(*) filter (event_type <> 'view')::bigint checked, count(*) filter (event_type = 'error')::bigint failures, count(*) filter (event_type = 'view')::bigint outages, count(*) filter (event_type = 'error') > 0.2 * count(*) filter (event_type <> 'view') as blocked from events group by 1")
def link_failure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.link_gate(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "view")


@query("select user_id, max(floor(epoch(ts))) - min(floor(epoch(ts))) >= 86400 as spanned from events where event_type = 'signup' group by 1")
def evidence_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.spans(table(spark, sf_dir, "events").where("event_type = 'signup'"), "user_id", health.epoch_seconds("ts"))


@query("""with prior as (select o_custkey, case when count(*) > 5 then null else min(o_orderdate) end first_at from orders where o_orderdate < timestamp '1996-01-01' group by 1),
 now as (select o_custkey, min(o_orderdate) seen from orders where o_orderdate >= timestamp '1996-01-01' group by 1)
 select n.o_custkey, strftime(case when p.o_custkey is not null then first_at else seen end, '%Y-%m-%d') as first_observed, case when p.o_custkey is not null and first_at is null then 'unknown' else 'exact' end as "precision" from now n left join prior p using (o_custkey)""")
def first_seen_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    prior = orders.where("o_orderdate < '1996-01-01'").groupBy("o_custkey").agg(F.when(F.count(F.lit(1)) <= 5, F.min("o_orderdate")).alias("first_observed_at"))
    now = orders.where("o_orderdate >= '1996-01-01'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"))
    return reconcile.first_seen(now, prior, "o_custkey", "at").select("o_custkey", F.date_format("first_observed_at", "yyyy-MM-dd").alias("first_observed"), "precision")


@query(f"""with {_CATALOG}, trusted as (select distinct c_nationkey from catalog where o_orderdate < timestamp '1993-06-01' and past)
 select o_orderkey, case when t.c_nationkey is null then 'baseline' else 'normal' end recency, t.c_nationkey is not null and status = 'open' and coalesce(technical, false) and direct as alert from catalog c left join trusted t using (c_nationkey) where not past""")
def quiet_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalog(spark, sf_dir)
    wanted = (F.col("status") == "open") & F.coalesce("technical", F.lit(False)) & F.col("direct")
    return reconcile.alerts(rows.where("not past"), "c_nationkey", rows.where("o_orderdate < '1993-06-01' and past"), wanted).select("o_orderkey", "recency", "alert")


@query("""with d as (select user_id, date_trunc('day', ts)::date as day, max(event_type) content from events group by 1, 2)
 select user_id, strftime(day, '%Y-%m-%d') as day, coalesce(content = lag(content) over (partition by user_id order by day), false) as unchanged from d""")
def unchanged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("event_type").alias("content"))
    return reconcile.unchanged(days, "user_id", "day", "content").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "unchanged")


@query("select s_suppkey as id, s_name as name, 'static' as origin from supplier where s_suppkey not in (select c_custkey from customer where c_acctbal > 0) union all select c_custkey, c_name, 'dynamic' from customer where c_acctbal > 0")
def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("static").alias("origin"))
    dynamic = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("dynamic").alias("origin"))
    return ledger.later_wins(static, dynamic, "id")


@query("select distinct o_custkey from orders where o_custkey not in (select user_id from events)")
def requested_not_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")), "o_custkey")


@query("""select c_nationkey, count(*)::bigint n_rows, (select string_agg(c_name, ',' order by c_custkey) from (select * from customer i where i.c_nationkey = o.c_nationkey order by c_custkey limit 3)) samples from customer o group by 1""")
def ledger_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.samples(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name").withColumn("samples", F.array_join("samples", ","))


@query("""with k as (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2)
 select c_nationkey, sum(n)::bigint n_rows, string_agg(c_mktsegment || '=' || n, ',' order by c_mktsegment) kinds, (select count(distinct floor(c_acctbal / 1000)) from customer c where c.c_nationkey = k.c_nationkey)::bigint places from k group by 1""")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("place", F.floor(F.col("c_acctbal") / 1000))
    out = ledger.summary(rows, "c_nationkey", "c_mktsegment", "place")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("c_nationkey", "n_rows", kinds.alias("kinds"), "places")


@query("select o_orderkey, strftime(o_orderdate, '%b %-d, %Y') as posted from orders")
def posting_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.posting_date(F.col("o_orderdate")).alias("posted"))


_AGES = """select event_id, case when past < 60 then 'just now' when past < 3600 then (past // 60) || 'm ago' when past < 86400 then (past // 3600) || 'h ago' when past < 604800 then (past // 86400) || 'd ago' else strftime(ts, '%b %-d, %Y') end as age,
 case when past // 86400 = 0 then 'Confirmed today' when past // 86400 = 1 then 'Confirmed yesterday' when past < 604800 then 'Confirmed ' || (past // 86400) || ' days ago' else 'Confirmed ' || strftime(ts, '%b %-d, %Y') end as freshness,
 strftime(ts - interval 5 hour, '%Y-%m') as period from (select *, greatest(1706659200 - floor(epoch(ts))::bigint, 0) past from events)"""


@query(_AGES)
def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events fall in January, when New York is five hours behind."""
    past, at = 1706659200 - health.epoch_seconds("ts"), F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", times.compact_age(past, at).alias("age"), times.freshness_label(past, at).alias("freshness"), times.monitoring_period(at.cast("timestamp")).alias("period"))


@query(f"""with {_STATES} select c_custkey, coalesce(state, 'never-ran') state, coalesce(failures, 0)::bigint failures, coalesce(orders, 0)::bigint checkpoint from customer left join states on user_id = c_custkey left join (select o_custkey, count(*) orders from orders group by 1) on o_custkey = c_custkey""")
def operations_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with each source's state and checkpoint."""
    states = _states(spark, sf_dir).withColumnRenamed("user_id", "c_custkey")
    checkpoints = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("checkpoint"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(states, "c_custkey", "left").join(checkpoints, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("state", F.lit("never-ran")).alias("state"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.coalesce("checkpoint", F.lit(0)).cast("long").alias("checkpoint"))


_SAME = """with recursive keyed as (select c_custkey, c_name, c_nationkey, c_acctbal, floor(c_acctbal)::bigint a, c_nationkey || '|' || c_mktsegment || '|' || c_custkey % 40 b from customer),
 links as (select x.c_custkey x, y.c_custkey y from keyed x join keyed y on x.a = y.a union select x.c_custkey, y.c_custkey from keyed x join keyed y on x.b = y.b),
 reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
 roots as (select x c_custkey, min(y) root from reach group by 1)"""


def _same(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").withColumns({"a": F.floor("c_acctbal"), "b": F.concat_ws("|", "c_nationkey", "c_mktsegment", F.col("c_custkey") % 40)})
    return rows, identity.same_items(rows, "c_custkey", ["a", "b"])


@query(f"{_SAME} select * from roots")
def same_role_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(spark, sf_dir)[1]


@query(f"{_SAME} select root, arg_min(c_name, c_custkey) title, min(c_acctbal) first_seen, max(c_acctbal) last_seen, array_to_string(list_sort(list_distinct(list(c_nationkey))), ',') sources, bool_or(c_acctbal > 5000) is_open, count(*)::bigint n_rows from keyed join roots using (c_custkey) group by 1")
def merge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, roots = _same(spark, sf_dir)
    out = identity.merge(rows.join(roots, "c_custkey"), "root", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_acctbal", F.col("c_acctbal") > 5000)
    return out.withColumn("sources", F.concat_ws(",", F.transform("sources", lambda x: x.cast("string"))))
