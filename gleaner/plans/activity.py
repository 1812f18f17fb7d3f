"""Queries on events, orders and their tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.hashing import event_id
from gleaner.operators import filters, gates, health, ledger, reads, reconcile
from gleaner.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The present time of the run queries, in seconds, and that of the catalog reads.
END, CUT = 1706659200, "2000-01-01"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"failed": F.col("event_type") == "error", "at": health.epoch_seconds("ts"), "provider": F.pmod("user_id", F.lit(5))})


_RUNS = "runs as (select *, event_type = 'error' failed, floor(epoch(ts))::bigint sec, user_id % 5 provider from events)"
_STREAK = f"{_RUNS}, islands as (select *, count(*) filter (not failed) over (partition by user_id order by ts, event_id) island from runs), streaks as (select *, count(*) filter (failed) over (partition by user_id, island order by ts, event_id)::bigint streak from islands)"
_LAST = f"{_STREAK}, last as (select user_id, arg_max(streak, (ts, event_id)) failures, max(sec) filter (not failed) ok_at, count(*) filter (not failed) succeeded from streaks group by 1)"


@query(f"with {_RUNS} select user_id, count(*)::bigint runs, count(*) filter (not failed)::bigint succeeded, count(*) filter (not failed) / count(*) as success_rate from runs group by 1")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.success_rate(_runs(spark, sf_dir), "user_id", F.col("failed"))


@query(f"with {_STREAK} select event_id, streak from streaks")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.with_streak(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("failed")).select("event_id", "streak")


@query("select user_id, nth::int nth, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) nth from events) where nth <= 25")
def recent_runs_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.newest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 25).select("user_id", "nth", "event_id")


@query(f"with {_RUNS} select sec // 1800 as \"window\", count(*)::bigint runs, count(*) filter (failed)::bigint failures from runs group by 1")
def poll_windows_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy(health.poll_window(F.col("at")).alias("window")).agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"))


@query(f"with {_RUNS} select user_id, sec // 1800 as \"window\", min(event_id) event_id from runs group by 1, 2")
def dispatch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("user_id", health.poll_window(F.col("at")).alias("window")).agg(F.min("event_id").alias("event_id"))


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaks = health.with_streak(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("failed"))
    return streaks.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).alias("failures"), F.max(F.when(~F.col("failed"), F.col("at"))).alias("ok_at"), F.count_if(~F.col("failed")).alias("succeeded"))


@query(f"with {_LAST} select user_id, failures::bigint failures, case when failures > 0 then least(1800, 60 * pow(2, least(failures, 20) - 1))::bigint else 0 end as backoff from last")
def backoff_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir).select("user_id", "failures", health.backoff_seconds(F.col("failures")).alias("backoff"))


@query(f"""with {_LAST} select user_id, case when failures >= 3 then 'quarantined' when ok_at is null then case when failures > 0 then 'degraded' else 'never-succeeded' end
  when failures > 0 or ({END} - ok_at) / 60 > case when user_id % 2 = 0 then 90 else 420 end then 'degraded' else 'healthy' end as state from last""")
def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures, ok_at = F.col("failures"), F.col("ok_at")
    state = gates.state_for(failures >= 3, ok_at, F.when(failures > 0, "degraded"), (F.lit(END) - ok_at) / 60, F.col("user_id") % 2 == 0)
    return _last(spark, sf_dir).select("user_id", state.alias("state"))


@query(f"""with {_LAST} select (user_id % 5)::bigint provider, count(*)::bigint sources, count(*) filter (ok_at is null or ({END} - ok_at) / 60 > case when user_id % 5 < 2 then 90 else 720 end)::bigint stale
  from last group by 1""")
def stale_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.pmod("user_id", F.lit(5)).cast("long")
    stale = F.col("ok_at").isNull() | ((F.lit(END) - F.col("ok_at")) / 60 > F.when(provider < 2, 90).otherwise(720))
    return _last(spark, sf_dir).groupBy(provider.alias("provider")).agg(F.count(F.lit(1)).alias("sources"), F.count_if(stale).alias("stale"))


@query(f"with {_RUNS} select provider::bigint provider, count(*)::bigint failed, count(distinct user_id)::bigint sources from runs where failed and sec > {END} - 86400 group by 1")
def failed_24h_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _runs(spark, sf_dir).where(F.col("failed") & (F.col("at") > END - 86400))
    return late.groupBy(F.col("provider").cast("long").alias("provider")).agg(F.count(F.lit(1)).alias("failed"), F.count_distinct("user_id").alias("sources"))


@query(f"with {_RUNS} select event_id from (select event_id, count(*) filter (failed) over (partition by user_id, sec // 86400 order by ts, event_id) n from runs) where n > 0")
def fifo_blocked_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumn("day", F.expr("at div 86400"))
    return health.blocked_suffix(runs, ["user_id", "day"], ["ts", "event_id"], F.col("failed")).select("event_id")


_DAYS = f"{_RUNS}, days as (select distinct sec // 86400 as day from runs), ids as (select distinct user_id from runs), grid as (select i.user_id, d.day, e.user_id is not null present from ids i cross join days d left join (select distinct user_id, sec // 86400 as day from runs where event_type = 'view') e on e.user_id = i.user_id and e.day = d.day)"


@query(f"""with {_DAYS}, islands as (select *, count(*) filter (present) over (partition by user_id order by day) island from grid),
s as (select user_id, day, count(*) filter (not present) over (partition by user_id, island order by day)::bigint omissions from islands) select user_id, day, omissions, omissions >= 2 as closed from s""")
def omission_streak_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are snapshots (a list as long as the calendar), a view is presence; ids by days is the state's size."""
    runs = _runs(spark, sf_dir).withColumn("day", F.expr("at div 86400"))
    days = runs.agg(F.collect_set("day").alias("days"))
    grid = runs.select("user_id").distinct().join(F.broadcast(days)).select("user_id", F.explode("days").alias("day"))
    seen = runs.where("event_type = 'view'").select("user_id", "day").distinct().withColumn("here", F.lit(True))
    here = F.coalesce("here", F.lit(False))
    out = health.with_streak(grid.join(seen, ["user_id", "day"], "left"), ["user_id"], ["day"], ~here, "omissions")
    return out.select("user_id", "day", "omissions", (F.col("omissions") >= reconcile.CLOSE_AFTER).alias("closed"))


@query(f"with {_RUNS} select user_id, sec // 86400 as day, count(distinct event_type)::bigint owners from runs group by 1, 2 having count(distinct event_type) > 1")
def ambiguous_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ambiguous(_runs(spark, sf_dir).withColumn("day", F.expr("at div 86400")), ["user_id", "day"], "event_type")


@query("select o_orderkey from orders where o_orderstatus = 'O' and (o_totalprice < 200000 or (o_totalprice = 200000 and o_orderkey < 100)) order by o_totalprice desc, o_orderkey desc limit 50")
def catalog_open_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 is the feature: the rows after the cursor (200000.0, 100)."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return reads.page(rows, [("o_totalprice", True), ("o_orderkey", True)], 50, (200000.0, 100)).select("o_orderkey")


@query(f"select o_orderkey from orders where o_orderstatus <> 'F' and o_orderdate > timestamp '1999-06-01' and o_orderdate <= timestamp '{CUT}'")
def inbox_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.since(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "o_orderdate", "1999-06-01", CUT).select("o_orderkey")


@query("""select o_orderkey, case c_mktsegment when 'BUILDING' then 30 when 'MACHINERY' then 20 else 0 end + least(o_totalprice / 1000, 100) / 2 as score
  from orders left join customer on o_custkey = c_custkey""")
def rank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    weight = F.when(segment == "BUILDING", 30).when(segment == "MACHINERY", 20).otherwise(0)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", reads.score(weight, F.col("o_totalprice") / 1000).alias("score"))


_FOLLOW = "follows as (select c_custkey, c_nationkey, unnest(case when c_mktsegment = 'BUILDING' then ['1-URGENT', '2-HIGH'] when c_acctbal > 5000 then ['3-MEDIUM'] else [] end) o_orderpriority from customer), jobs as (select o_orderkey, o_orderpriority, o_totalprice, c_nationkey from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'), pairs as (select j.*, f.c_custkey follower from jobs j join follows f using (c_nationkey, o_orderpriority) where o_totalprice > 100000)"


def _jobs_and_follows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer")
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).when(F.col("c_acctbal") > 5000, F.array(F.lit("3-MEDIUM")))
    follows = customer.select(F.col("c_custkey").alias("follower"), "c_nationkey", F.explode(wanted).alias("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice > 100000")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_nationkey"), follows


@query(f"with {_FOLLOW} select follower, count(*)::bigint matches from pairs group by 1")
def fanout_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, follows = _jobs_and_follows(spark, sf_dir)
    return filters.match_counts(jobs, follows, ["c_nationkey", "o_orderpriority"], "follower")


@query(f"with {_FOLLOW} select follower, count(*)::bigint matches from pairs p where not exists (select 1 from lineitem l where l.l_orderkey = p.o_orderkey and l_returnflag = 'R') group by 1")
def fanout_anti_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    jobs, follows = _jobs_and_follows(spark, sf_dir)
    return filters.match_counts(reads.not_among(jobs, receipts, ["o_orderkey"]), follows, ["c_nationkey", "o_orderpriority"], "follower")


@query("select o_orderkey, sha256(concat_ws('|', o_custkey::varchar, o_orderkey::varchar, o_orderpriority, 'new-job')) as event_id from orders o where o_orderstatus = 'O' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')")
def event_id_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("event_id", event_id(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")))
    sent = orders.join(table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return reconcile.outbox(orders.where("o_orderstatus = 'O'").select("o_orderkey", "event_id"), sent)


@query("""with n as (select l_suppkey, l_returnflag, count(*) c from lineitem group by 1, 2), m as (select l_suppkey, first(l_returnflag order by c desc, l_returnflag) as name, count(*)::bigint variants from n group by 1)
select l_suppkey, count(*)::bigint sightings, count(distinct l_orderkey)::bigint sources, any_value(name) as name, any_value(variants) variants from lineitem join m using (l_suppkey) group by 1""")
def candidate_ledger_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.candidate_ledger(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_orderkey")


@query("""with e as (select distinct l_suppkey id from lineitem where l_quantity >= 50 and l_discount >= 0.09), s as (select s_suppkey id from supplier where s_acctbal > 0)
select id, 'registry' as side from s where id not in (select id from e) union all select id, 'evidence' from e where id not in (select id from s)""")
def registry_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09")
    return ledger.orphans(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), evidence, "s_suppkey", "l_suppkey")


@query("""select o_orderkey, date_diff('day', o_orderdate, min(l_shipdate) filter (l_linestatus = 'O'))::bigint direct_lag, date_diff('day', o_orderdate, min(l_shipdate) filter (l_linestatus = 'F'))::bigint other_lag
  from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate""")
def first_seen_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda s: F.min(F.when(F.col("l_linestatus") == s, F.col("l_shipdate")))
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(first("O").alias("direct"), first("F").alias("other"))
    joined = table(spark, sf_dir, "orders").join(seen, "o_orderkey")
    return joined.select("o_orderkey", *(F.datediff(c, "o_orderdate").cast("long").alias(f"{c}_lag") for c in ("direct", "other")))


@query("""select l_orderkey, strftime(coalesce(min(l_shipdate) filter (l_linestatus = 'O'), min(l_shipdate)), '%Y-%m-%d') as published_on, bool_or(l_linestatus = 'O') as is_official from lineitem group by 1""")
def earliest_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("official", F.col("l_linestatus") == "O")
    return ledger.earliest_publication(rows, "l_orderkey", "l_shipdate", "official", "l_returnflag").select("l_orderkey", F.date_format("published_at", "yyyy-MM-dd").alias("published_on"), "is_official")


@query(f"""with a as (select distinct o_custkey id from orders where o_orderdate < timestamp '{CUT}'), b as (select distinct o_custkey id from orders where o_orderdate >= timestamp '{CUT}')
select coalesce(a.id, b.id) as external_id, b.id is not null as present, case when b.id is null then 1 else 0 end::int as omissions, true as "open",
  case when a.id is null then 'new' when b.id is null then 'omitted' else 'present' end as change from a full join b on a.id = b.id""")
def reconcile_two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who ordered before a day is the state, who ordered from it on is the snapshot."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("external_id"), "o_orderdate")
    prior = orders.where(F.col("o_orderdate") < CUT).select("external_id").distinct().withColumns({"present": F.lit(True), "omissions": F.lit(0), "open": F.lit(True)})
    return reconcile.reconcile(prior, orders.where(F.col("o_orderdate") >= CUT), ["external_id"])


@query("select c_mktsegment, count(*)::bigint jobs, count(*) filter (c_acctbal > 0)::bigint open_jobs, bool_or(c_acctbal > 9000) as any_rich from customer group by 1")
def any_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("c_acctbal") > 0).alias("open_jobs"), F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich"))
