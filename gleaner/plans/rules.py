"""Queries of folds over time, identity by similar titles and merges on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.url import host
from gleaner.operators import attribution, classify, coverage, delivery, evidence, filters, health, identity, incidents, messages, processing, promotion, versions
from gleaner.plans.catalog import _HOST, _collapsed, _decoded
from gleaner.plans.tables import AGGREGATORS, NOW, WORDS, page_titles, table
from gleaner.sources import lists
from gleaner.streaming import presence

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("""with here as (select event_type source_id, user_id::varchar external_id, max(dayofyear(ts)) last from events group by 1, 2),
 days as (select distinct event_type source_id, dayofyear(ts) d from events)
 select source_id, external_id, missed = 0 as present, least(missed, 2)::int omissions, missed < 2 as open
 from (select h.*, (select count(*) from days x where x.source_id = h.source_id and x.d > h.last) missed from here h)""")
def folded_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of each kind of event for each day with the users that it names, folded in three overlapping batches."""
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.dayofyear("ts").cast("long").alias("number"), F.col("user_id").cast("string").alias("external_id"))
    state = spark.createDataFrame([], presence.FOLDED)
    for batch in (seen.where("number <= 10"), seen.where("number between 5 and 20"), seen.where("number > 20")):
        state = presence.fold_snapshots(state, batch)
    return state.where("external_id is not null").drop("number")


_HEALTH = """with recursive e as (
  select user_id, event_id, floor(epoch(ts))::bigint tm, (json_extract_string(props, '$.k'))::int k, event_type, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) n from events),
 x as (select *, case when event_type = 'signup' then 'command' when event_type = 'view' and k % 5 = 0 then 'check' when event_type = 'error' then 'fail' else 'ok' end kind,
   case k % 9 when 0 then 'pause' when 1 then 'resume' when 2 then 'quiet' when 3 then 'fast' when 4 then 'quarantine' when 5 then 'acknowledge' when 6 then 'resolve' when 7 then 'recover' else 'replay' end action,
   case when k < 15 then 'transport' when k < 55 then 'http' when k < 70 then 'identity' when k < 85 then 'quality' else 'empty' end category,
   case when k between 15 and 24 then 429 when k between 25 and 34 then 503 when k between 35 and 54 then 404 end status from e),
 r as (
  select user_id, 0::bigint n, null::bigint event_id, null::boolean accepted, null::varchar state, null::varchar source_status, null::varchar poll_tier, null::varchar poll_tier_mode, null::bigint config_version, null::bigint failures,
    null::varchar incident, null::varchar severity, null::bigint opened_at, null::bigint updated_at, null::bigint last_success_at, null::bigint backoff_until from (select distinct user_id from e)
  union all
  select user_id, n, event_id, accepted,
    case when not accepted then state when kind = 'ok' then 'healthy' when kind = 'fail' then case when q then 'quarantined' else 'degraded' end when kind = 'check' then state when action = 'quarantine' then 'quarantined' else coalesce(state, 'never-succeeded') end,
    case when not accepted or kind = 'check' then source_status when kind in ('ok', 'fail') then coalesce(source_status, 'active') when action in ('pause', 'quarantine', 'recover') then 'paused' when action = 'resume' then 'active' else source_status end,
    case when not accepted or kind = 'check' then poll_tier when kind = 'ok' then case when poll_tier_mode = 'operator' then coalesce(poll_tier, tier) else tier end when kind = 'fail' then coalesce(poll_tier, 'active') when action = 'quiet' then 'quiet' else poll_tier end,
    case when not accepted then poll_tier_mode when kind = 'ok' then coalesce(poll_tier_mode, 'automatic') when kind = 'command' and action = 'quiet' then 'operator' else poll_tier_mode end,
    case when not accepted or kind = 'check' then config_version when kind in ('ok', 'fail') then coalesce(config_version, 1) when action = 'replay' then config_version else coalesce(config_version, 0) + 1 end,
    case when not accepted then failures when kind = 'ok' then 0 when kind = 'fail' then f when kind = 'check' then failures else coalesce(failures, 0) end,
    case when not accepted then incident when kind = 'ok' then 'resolved' when kind = 'fail' then case when opens then case when incident = 'acknowledged' then incident else 'open' end else coalesce(incident, 'resolved') end
      when kind = 'check' then stale when action = 'quarantine' then 'open' when action in ('acknowledge', 'recover') then 'acknowledged' when action = 'resolve' then 'resolved' else incident end,
    case when not accepted then severity when kind = 'ok' then case when live then severity end when kind = 'fail' then case when opens then case when q or f >= 3 then 'high' else 'warning' end end when kind = 'check' or action = 'quarantine' then 'high' else severity end,
    case when not accepted then opened_at when kind = 'ok' then case when live then opened_at end when kind = 'fail' then case when opens then coalesce(opened_at, tm) end when kind = 'check' or action = 'quarantine' then coalesce(opened_at, tm) else opened_at end,
    case when not accepted then updated_at when kind = 'ok' then case when live then tm end when kind = 'fail' then case when opens then tm end when kind = 'check' or action in ('quarantine', 'acknowledge', 'resolve', 'recover') then tm else updated_at end,
    case when kind = 'ok' then tm else last_success_at end,
    case when not accepted then backoff_until when kind = 'ok' then null when kind = 'fail' then case when category = 'transport' or status = 429 or status = 503 then tm + least(1800, greatest(case when status = 429 then k * 20 else 0 end, least(1800, 60 * (2 ** least(f - 1, 10))::bigint))) end when kind = 'command' and action = 'resume' then null else backoff_until end
  from (select *, q or f >= 2 as opens, coalesce(incident <> 'resolved', false) live,
      case when kind in ('ok', 'fail') then true
        when kind = 'check' then state is not null and source_status is distinct from 'paused' and coalesce(tm - last_success_at >= 5400, false) and not coalesce(incident = stale and severity = 'high' and updated_at // 60 = tm // 60, false)
        when action = 'fast' then false when action = 'acknowledge' then coalesce(incident <> 'resolved', false) when action = 'recover' then coalesce(state = 'quarantined', false) else true end accepted
    from (select r.user_id, x.n, x.event_id, x.tm, x.k, x.kind, x.action, x.category, x.status, r.state, r.source_status, r.poll_tier, r.poll_tier_mode, r.config_version, r.failures, r.incident, r.severity, r.opened_at, r.updated_at, r.last_success_at, r.backoff_until,
        coalesce(r.failures, 0) + 1 as f, case when x.k % 3 > 0 then 'active' else 'quiet' end tier, case when r.incident = 'acknowledged' then 'acknowledged' else 'open' end stale,
        x.category = 'identity' or (x.category = 'http' and coalesce(x.status = 404, false)) or (x.category in ('quality', 'empty') and coalesce(r.failures, 0) + 1 >= 2) as q
      from r join x on x.user_id = r.user_id and x.n = r.n + 1)))
"""
_HEALTH_COLUMNS = "accepted, state, source_status, poll_tier, poll_tier_mode, config_version, failures, incident, severity, opened_at, updated_at, last_success_at, backoff_until"


def _health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    command, check, fail = kind == "signup", (kind == "view") & (k % 5 == 0), kind == "error"
    category = F.when(k < 15, "transport").when(k < 55, "http").when(k < 70, "identity").when(k < 85, "quality").otherwise("empty")
    status = F.when(k.between(15, 24), 429).when(k.between(25, 34), 503).when(k.between(35, 54), 404)
    names = ["pause", "resume", "set-tier", "set-tier", "quarantine", "acknowledge", "resolve", "recover", "replay"]
    action = F.get(F.array(*map(F.lit, names)), k % 9)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source_id"), health.epoch_seconds("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(command, "command").when(check, "check").otherwise("run").alias("kind"), (~fail).alias("ok"), (k % 3).cast("long").alias("eligible"), (k % 2 == 0).alias("changed"),
        category.alias("category"), status.alias("status"), F.coalesce((category == "transport") | status.isin(429, 503), F.lit(False)).alias("retryable"), F.when(status == 429, k * 20).cast("long").alias("retry_after"),
        action.alias("action"), F.when(k % 9 == 2, "quiet").when(k % 9 == 3, "fast").otherwise("broken rows").alias("argument"),
    )


@query(f"{_HEALTH} select event_id, {_HEALTH_COLUMNS} from r where n > 0")
def health_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's health after every run, command and freshness check."""
    return incidents.transitions(_health_events(spark, sf_dir)).select(F.col("seq").alias("event_id"), *_HEALTH_COLUMNS.split(", "))


@query(f"{_HEALTH} select user_id::varchar source_id, {_HEALTH_COLUMNS.removeprefix('accepted, ')} from r where n > 0 qualify row_number() over (partition by user_id order by n desc) = 1")
def health_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.final_states(incidents.transitions(_health_events(spark, sf_dir))).select("source_id", *_HEALTH_COLUMNS.removeprefix("accepted, ").split(", "))


_ROLES = """with recursive p as (select p_partkey k, p_brand c, p_type s, p_name || ' w' || p_size % 3 || ' x' || p_size % 4 || ' y' || p_size % 2 || case when p_size % 7 = 0 then ' (zz' else '' end || case when p_size % 11 = 0 then 'z) q' else '' end t,
   p_size % 5 = 0 r, case when p_partkey % 50 = 0 then p_partkey // 100 end url from part),
 n as (select *, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9+#/ ]+', ' ', 'g'), ' +', ' ', 'g')) u from p),
 w as (select *, list_distinct(string_split(u, ' ')) ws from n),
 role as (select a.k, min(b.k) other from w a join w b on a.c = b.c and a.s = b.s and a.r and b.k < a.k
   where starts_with(a.u, b.u) or starts_with(b.u, a.u) or len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) >= 0.8 group by 1)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    title = F.concat("p_name", F.lit(" w"), size % 3, F.lit(" x"), size % 4, F.lit(" y"), size % 2, F.when(size % 7 == 0, " (zz").otherwise(""), F.when(size % 11 == 0, "z) q").otherwise(""))
    url = F.when(F.col("p_partkey") % 50 == 0, F.floor(F.col("p_partkey") / 100))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", title.alias("title"), (size % 5 == 0).alias("repaired"), url.alias("url"))


@query(f"{_ROLES} select k p_partkey, other from role")
def role_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.role_links(_roles(spark, sf_dir), "p_partkey", "p_brand", "p_type", "title", "repaired")


@query(f"""{_ROLES}, links as (select k x, other y from role union select a.k, b.k from n a join n b on a.url = b.url union select a.k, b.k from n a join n b on a.c = b.c and a.s = b.s and a.u = b.u),
 ways as (select x, y from links union select y, x from links), reach(x, y) as (select x, y from ways union select r.x, b.y from reach r join ways b on b.x = r.y)
 select x p_partkey, min(y) root from reach group by 1""")
def snapshot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for rows of one address, of one fingerprint, or of one role with a repaired title."""
    rows = _roles(spark, sf_dir).withColumn("fingerprint", F.concat_ws("|", "p_brand", "p_type", identity.plain_words(F.col("title"))))
    return identity.same_items(rows, "p_partkey", ["url", "fingerprint"], identity.role_links(rows, "p_partkey", "p_brand", "p_type", "title", "repaired"))


_MERGED = """with stored as (select c_custkey job, case when c_custkey % 3 > 0 then c_mktsegment end company, case when c_custkey % 4 > 0 then c_name end title, case when c_nationkey % 2 = 0 then 'Unknown' else 'n' || c_nationkey end "location", 'old' season,
   'u' || c_custkey % 6 url, case when c_custkey % 5 = 0 then 'day' end validated_at, case when c_custkey % 2 = 1 then 'u1' end invalid_url, c_acctbal hourly, null::varchar requirements, -1 as "order" from customer),
 listings as (select o_custkey job, o_orderpriority company, o_orderpriority || ' role' title, case o_orderstatus when 'F' then '' when 'P' then 'TBD' else 'loc ' || o_orderkey % 7 end "location", o_orderpriority season, 'u' || o_orderkey % 6 url,
   case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y-%m-%d') end validated_at, null invalid_url, case when o_totalprice > 250000 then o_totalprice else 0 end hourly, case when o_orderkey % 5 = 0 then 'r' || o_orderkey % 3 end requirements, o_orderkey "order",
   o_orderstatus source_id, o_orderkey % 10 external_id, case when o_orderstatus = 'O' then 'open' else 'closed' end state, case o_orderkey % 3 when 0 then true when 1 then false end technical from orders),
 b as (select * from stored union all by name select * exclude (source_id, external_id, state, technical) from listings),
 refs as (select job, source_id, external_id, arg_max(state, "order") state, arg_max(coalesce(technical, true), "order") technical from listings group by 1, 2, 3),
 r as (select job, bool_or(state = 'open') any_open, bool_or(state = 'open' and technical) technical, string_agg(source_id || '|' || external_id || '|' || state, ',' order by source_id || '|' || external_id || '|' || state) "references" from refs group by 1),
 j as (select job, arg_min(company, "order") filter (coalesce(company, '') <> '') company, arg_min(title, "order") filter (coalesce(title, '') <> '') title,
   coalesce(arg_min("location", "order") filter (lower(trim("location")) not in ('', 'unknown', 'tbd')), arg_max("location", "order") filter ("location" <> '')) "location", arg_max(season, "order") season,
   coalesce(arg_max(url, "order") filter ("order" >= 0 and validated_at is not null), arg_min(url, "order")) url, coalesce(arg_max(validated_at, "order") filter ("order" >= 0 and validated_at is not null), max(validated_at) filter ("order" < 0)) validated_at,
   arg_max(hourly, "order") filter (hourly > 0 or "order" < 0) hourly, arg_max(requirements, "order") filter (requirements is not null) requirements, max(invalid_url) invalid, count(*) filter ("order" >= 0) n_listings, coalesce(bool_and(url = 'u1') filter ("order" >= 0), true) only_invalid from b group by 1)
"""


@query(_MERGED + """select job, company, title, "location", season, url, validated_at, hourly, requirements, case when only_invalid then invalid end invalid_url, coalesce(any_open, false) and not (only_invalid and invalid is not null) as open,
 coalesce(technical, false) technical, coalesce("references", '') "references", n_listings from j left join r using (job)""")
def merged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored jobs, their orders as listings, merged field by field."""
    c, o, null = F.col, F.col("o_orderkey"), F.lit(None).cast("string")
    stored = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("job"), F.when(c("c_custkey") % 3 > 0, c("c_mktsegment")).alias("company"), F.when(c("c_custkey") % 4 > 0, c("c_name")).alias("title"),
        F.when(c("c_nationkey") % 2 == 0, "Unknown").otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("location"), F.lit("old").alias("season"), F.concat(F.lit("u"), c("c_custkey") % 6).alias("url"),
        F.when(c("c_custkey") % 5 == 0, "day").alias("validated_at"), F.when(c("c_custkey") % 2 == 1, "u1").alias("invalid_url"), c("c_acctbal").alias("hourly"), null.alias("requirements"),
    )
    status = c("o_orderstatus")
    listings = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("job"), c("o_orderpriority").alias("company"), F.concat("o_orderpriority", F.lit(" role")).alias("title"), F.when(status == "F", "").when(status == "P", "TBD").otherwise(F.concat(F.lit("loc "), o % 7)).alias("location"),
        c("o_orderpriority").alias("season"), F.concat(F.lit("u"), o % 6).alias("url"), F.when(o % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("validated_at"), F.when(c("o_totalprice") > 250000, c("o_totalprice")).otherwise(0.0).alias("hourly"),
        F.when(o % 5 == 0, F.concat(F.lit("r"), o % 3)).alias("requirements"), o.alias("order"), status.alias("source_id"), (o % 10).alias("external_id"), F.when(status == "O", "open").otherwise("closed").alias("state"), F.when(o % 3 == 0, True).when(o % 3 == 1, False).alias("technical"),
    )
    address = lambda d: d.withColumn("apply_url", c("url"))
    out = identity.merge_listings(address(stored), address(listings), "now")
    return out.withColumn("references", F.coalesce(F.array_join("references", ","), F.lit(""))).select("job", "company", "title", "location", "season", "url", "validated_at", "hourly", "requirements", "invalid_url", "open", "technical", "references", "n_listings")


_WANTED = {
    0: {"include_keywords": ["rin", "LUE b"]},
    1: {"include_categories": ["metal"]},
    2: {"include_keywords": ["hot"], "include_categories": ["toy"], "exclude_keywords": ["Small"]},
    3: {"include_keywords": ["#1"], "include_employers": ["startup"]},
    4: {"exclude_categories": ["toy"], "exclude_employers": ["faang"]},
    5: {"include_keywords": ["gi", " ring ", "RING"], "include_categories": ["metal"]},
    6: {"include_keywords": ["nothing like it"]},
}
_KINDS = {"metal": "bolt|gear|ring", "toy": "widget|gizmo"}
_LABELS = {"metal": "Metal parts", "toy": "Toys"}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


_SAVED = " union all ".join(f"select {k} m, " + ", ".join(f"{_sql_list(f.get(n, []))} {n}" for n in ("include_keywords", "include_categories", "include_employers", "exclude_keywords", "exclude_categories", "exclude_employers")) for k, f in _WANTED.items())


@query(rf"""with saved as ({_SAVED}),
 f as (select s_suppkey, saved.* from supplier join saved on m = s_suppkey % 7 where s_suppkey % 13 > 0 and s_suppkey % 11 > 0),
 j as (select p_partkey, lower(p_brand || ' ' || p_name || ' ' || p_type) v, list_filter([case when regexp_matches(p_name, '\b(bolt|gear|ring)\b') then 'metal' end, case when regexp_matches(p_name, '\b(widget|gizmo)\b') then 'toy' end], lambda x: x is not null) c,
   ['faang', 'startup', 'normal'][p_partkey % 3 + 1] e from part),
 x as (select *, list_filter(include_categories, lambda k: list_contains(c, k)) rc, list_filter(include_keywords, lambda k: contains(v, lower(trim(k)))) rk, list_filter(include_employers, lambda k: k = e) re from j join f on not (
   list_has_any(c, exclude_categories) or list_contains(exclude_employers, e) or len(list_filter(exclude_keywords, lambda k: contains(v, lower(trim(k))))) > 0)),
 ok as (select *, len(include_keywords) + len(include_categories) = 0 as free from x where (len(include_keywords) + len(include_categories) = 0 or len(rc) + len(rk) > 0) and (len(include_employers) = 0 or len(re) > 0)),
 receipts as (select l_partkey, l_suppkey, min(l_linenumber) n from lineitem group by 1, 2)
 select p_partkey, s_suppkey, coalesce(n, 0)::bigint + 1 attempts,
   array_to_string(list_concat(case when free then ['default-all-technical:All technical roles'] else []::varchar[] end, list_transform(rc, lambda k: 'category:' || case k when 'metal' then 'Metal parts' else 'Toys' end),
     list_transform(list_filter(rk, lambda k, i: list_position(list_transform(rk, lambda y: lower(trim(y))), lower(trim(k))) = i), lambda k: 'keyword:' || trim(k)), list_transform(re, lambda k: 'company-type:' || k)), ',') reasons
 from ok left join receipts on l_partkey = p_partkey and l_suppkey = s_suppkey where n is null or n > 3""")
def filter_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs for suppliers with saved filters, without those that have a receipt; line items are the receipts."""
    names = [x.split()[0] for x in filters.FILTER.split(", ")]
    key = F.col("s_suppkey")
    value = lambda f, n: f.get(n) and F.array(*map(F.lit, f[n]))
    one = lambda f: F.struct(*((F.lit(False) if n.endswith(("citizenship", "degree")) else value(f, n) if f.get(n) else F.lit(None).cast("array<string>")).alias(n) for n in names))
    chosen = F.coalesce(*(F.when(key % 7 == k, one(f)) for k, f in _WANTED.items()))
    saved = table(spark, sf_dir, "supplier").select("s_suppkey", (key % 13 > 0).alias("alerts_enabled"), F.lit(True).alias("onboarding_complete"), chosen.alias("filter"))
    devices = table(spark, sf_dir, "supplier").select("s_suppkey", key.cast("string").alias("token"), (key % 11 > 0).alias("active"))
    part = table(spark, sf_dir, "part")
    jobs = part.select("p_partkey", filters.search_terms("p_brand", "p_name", "p_type").alias("value"), classify.classify(F.col("p_name"), _KINDS).alias("categories"), F.get(F.array(*map(F.lit, ("faang", "startup", "normal"))), (F.col("p_partkey") % 3).cast("int")).alias("employer"))
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_linenumber").alias("attempts"))
    status = F.when(F.col("attempts") == 1, "ok").when(F.col("attempts") == 2, "pending").when(F.col("attempts") == 3, "retryable").otherwise("error")
    receipts = line.withColumns({"token": F.col("s_suppkey").cast("string"), "status": status})
    e = filters.evaluate_filter(F.col("value"), F.col("categories"), F.col("employer"), category_labels=_LABELS)
    reasons = F.array_join(F.transform(e["reasons"], lambda r: F.concat_ws(":", r["kind"], r["label"])), ",")
    sent = filters.fan_out(jobs, "p_partkey", "value", "categories", saved, "s_suppkey", devices, receipts, F.struct(e["matches"].alias("matches"), reasons.alias("reasons")))
    return sent.select("p_partkey", "s_suppkey", F.col("attempts").cast("long").alias("attempts"), "reasons")


def _sql_text(x: str) -> str:
    for tag in ("script", "style", "svg"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return _decoded(_collapsed(rf"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


def _sql_role(x: str) -> str:
    x = f"strip_accents(lower(coalesce({x}, '')))"
    for pattern, stem in evidence.STEMS:
        x = f"regexp_replace({x}, '{pattern}', ' {stem} ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9+#.]+', ' ', 'g'), ' +', ' ', 'g'))"


_TITLE, _SAID = r"regexp_extract(html, '(?is)<title>(.*?)</title>', 1)", "' Responsibilities and role of the engineer'"
_WORDS = "[" + ", ".join(f"'{w}'" for w in evidence.IGNORED) + "]"
_SEASONS = "[" + ", ".join(f"'{w}'" for w in evidence.SEASONAL) + "]"


@query(rf"""with h as (select page_id, coalesce(html, '') html from pages), p as (select page_id, html, {_TITLE} title, regexp_replace({_TITLE}, '[^A-Za-z ]', '', 'g') words from h),
 c as (select *, case when page_id % 4 = 0 then 'json-ld' when regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) <> '' then 'main' else 'body' end src,
   {_sql_text(rf"case when page_id % 4 = 0 then '<p>' || words || '</p>' || repeat({_SAID}, 9) when regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) <> '' then regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) when regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) <> '' then regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) else html end")} body from p),
 e as (select *, substr(body, 1, 12000) excerpt, {_sql_role("split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) || ' ' || split_part(title, ' ', 3) || ' engineer intern'")} role, {_collapsed("title")} t from c),
 g as (select *, {_sql_role("case when page_id % 3 > 0 then title || ' ' || excerpt else split_part(title, ' ', 2) end")} page, t <> '' and not regexp_matches(t, '(?i)\b(?:{evidence.ROLE})\b') and (regexp_matches(t, '(?i)\b(?:{evidence.GENERIC})\b') or len(regexp_split_to_array(t, '\s+')) <= 3) as general from e),
 w as (select *, string_split(role, ' ') rs, string_split(page, ' ') ps from g),
 f as (select *, array_to_string(list_filter(rs, lambda x: not list_contains({_SEASONS}, x)), ' ') phrase, list_distinct(list_filter(rs, lambda x: len(x) > 1 and not list_contains({_WORDS}, x) and not regexp_full_match(x, '202\d'))) terms from w),
 a as (select *, case when page = '' then 'weak' when contains(phrase, ' ') and contains(page, phrase) then 'strong' when len(terms) = 0 then 'partial'
   when len(list_intersect(terms, list_distinct(ps))) / len(terms) >= 0.75 then 'strong' when len(list_intersect(terms, list_distinct(ps))) / len(terms) >= 0.4 then 'partial' else 'weak' end agreement,
   length(excerpt) >= 300 as long, length(excerpt) >= 300 and regexp_matches(excerpt, '(?i)\b(?:responsibilities|qualifications|requirements|what you(?:''|’)ll do|about the role|apply|intern(?:ship)?)\b') as described from f),
 b as (select *, 35 + case when title <> '' then 20 else 0 end + case when regexp_matches(title, '(?i)\b(?:{evidence.ROLE}|job|position|role)\b') then 10 else 0 end + case when long then 10 else 0 end + case when described then 5 else 0 end
   + case when page_id % 5 = 0 then case when contains(html, page_id::varchar) then 20 else 0 end when title <> '' then 5 else 0 end raw from a),
 s as (select *, least(100, case when general then least(raw, 65) else raw end) base from b),
 x as (select *, case when page_id % 7 = 0 or (general and agreement <> 'strong') then least(65, case when agreement = 'strong' and described then greatest(base, 75) else base end) when agreement = 'strong' and described then greatest(base, 75) else base end score from s)
 select page_id, case when body <> '' then src end content_source, case when body <> '' then sha256(body) end content_hash, agreement, score::int confidence, case when score >= 70 then 'alert-eligible' when score >= 45 then 'catalog-only' else 'review' end recommendation from x""")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as postings for the first words of their title; every fourth gets its text as JSON-LD, every seventh counts as redirected."""
    title = F.coalesce(F.col("title"), F.lit(""))
    words = F.regexp_replace(title, "[^A-Za-z ]", "")
    said = F.concat(F.lit('<script type="application/ld+json">[{"@graph": [{"@type": ["Thing", "JobPosting"], "description": "<p>'), words, F.lit("</p>"), F.repeat(F.lit(_SAID.strip("'")), 9), F.lit('"}]}]</script>'))
    plain = F.coalesce(F.col("html"), F.lit(""))
    pages = page_titles(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat(said, plain)).otherwise(plain)).withColumn("_plain", plain)
    rows = evidence.with_content(pages)
    key, excerpt = F.col("page_id"), F.col("excerpt")
    nth = lambda n: F.coalesce(F.get(F.split(title, " "), F.lit(n)), F.lit(""))
    role = evidence.role_text(F.concat_ws(" ", nth(0), nth(1), nth(2), F.lit("engineer intern")))
    rows = rows.withColumns({"_role": role, "_page": evidence.role_text(F.when(key % 3 > 0, F.concat_ws(" ", title, F.coalesce(excerpt, F.lit("")))).otherwise(nth(1)))})
    rows = rows.withColumn("agreement", evidence.role_agreement(F.col("_role"), F.col("_page")))
    base = evidence.page_confidence(F.lit(True), title, F.lit(None).cast("string"), excerpt, F.when(key % 5 == 0, key.cast("string")), F.contains("_plain", key.cast("string")), F.lit(False), F.lit(False))
    rows = rows.withColumn("_base", base).withColumn("_e", evidence.assess(F.col("_base"), F.col("agreement"), title, excerpt, key % 7 == 0))
    return rows.select("page_id", "content_source", "content_hash", "agreement", F.col("_e.score").alias("confidence"), F.col("_e.recommendation").alias("recommendation"))


_SAFE = "trim(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1), '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""with p as (select page_id, {_SAFE} title, trim(url) url from pages where regexp_matches(trim(url), '^https?://[^\\s)<>]+$')),
 w as (select *, case when title = '' then 'x' else title end t from p)
 select page_id, n::int n, case when page_id % 3 = 2 and n = 2 then 'Beta' else 'Acme ' || page_id end company,
   case when page_id % 3 = 2 then case when n = 1 then 'Quantitative Trading Intern' else 'Ops Intern — Summer' end else t || case when n = 2 then ' two' else '' end end title,
   case when page_id % 3 = 0 then case when n = 1 then 'Here' else 'Unspecified' end when page_id % 3 = 1 then 'Unspecified' else case when n = 1 then 'Chicago' else 'Unspecified' end end "location", regexp_replace(url, '[,.;]+$', '') || case when n = 2 then '/two' else '' end apply_url, n = 2 and page_id % 3 <> 1 as closed
 from w cross join range(1, 3) r(n)""".replace("regexp_replace(url, '[,.;]+$', '') || case", "url || case"))
def listed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's title and address as a list document of two roles: a Markdown table, an HTML table or sections."""
    c, key = F.col, F.col("page_id")
    title = F.trim(F.regexp_replace(F.regexp_replace(c("title"), "[^A-Za-z ]+", " "), " +", " "))
    pages = page_titles(spark, sf_dir).select("page_id", F.when(title == "", "x").otherwise(title).alias("t"), F.trim("url").alias("url")).where(c("url").rlike(r"^https?://[^\s)<>]+$"))
    company = F.concat(F.lit("Acme "), key)
    markdown = F.concat(F.lit("# List\n| Company | Role | Location | Apply |\n| --- | --- | --- | --- |\n| **"), company, F.lit("** | "), c("t"), F.lit(" | Here | [Apply]("), c("url"), F.lit(") |\n| ↳ | "), c("t"), F.lit(" two | | [Apply]("), c("url"), F.lit("/two) Closed |\n"))
    html = F.concat(F.lit("<table><tr><th>Company</th><th>Role</th><th>Application</th></tr><tr><td>"), company, F.lit("</td><td><b>"), c("t"), F.lit('</b></td><td><a href="'), c("url"), F.lit('">Apply</a></td></tr><tr><td>↳</td><td>'), c("t"), F.lit(' two</td><td><a href="'), c("url"), F.lit('/two">Apply</a></td></tr></table>'))
    sections = F.concat(F.lit("## "), company, F.lit("\n**Locations**: Chicago\n| Role | Links |\n| --- | --- |\n| QT | [Apply]("), c("url"), F.lit(") |\n## Beta\n| Ops | [Summer]("), c("url"), F.lit("/two) 🔒 |\n"))
    docs = pages.select("page_id", F.when(key % 3 == 0, markdown).when(key % 3 == 1, html).otherwise(sections).alias("text"))
    rows = lambda d, layout: d.select("page_id", F.posexplode(lists.parse_lists(c("text"), layout)).alias("n", "r"))
    every = rows(docs.where(key % 3 < 2), "tables").unionByName(rows(docs.where(key % 3 == 2), "sections"))
    return every.select("page_id", (c("n") + 1).alias("n"), *(c(f"r.{x}").alias(x) for x in ("company", "title", "location", "apply_url", "closed")))


_KNOWN = ["Der", "The", "Les deux", "Les"]
_PLAIN = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+#/ ]+', ' ', 'g'), ' +', ' ', 'g'))"
_CLEAN = lambda x: _collapsed(f"regexp_replace({_decoded(x)}, '<[^>]+>', ' ', 'g')")
_REPAIR = rf"""w as (select *, regexp_matches(src, '(?:\.\.\.|…)\s*$') cut, trim(regexp_replace(src, '(?:\.\.\.|…)\s*$', '')) stem, {_PLAIN(r"trim(regexp_replace(src, '(?:\.\.\.|…)\s*$', ''))")} u from t),
 best as (select a.host, a.u, arg_min(b.src, (len(b.src), b.src)) whole from (select distinct host, u from w where cut and u <> '') a join (select distinct host, src, u from w where not cut) b on a.host = b.host and starts_with(b.u, a.u) group by 1, 2),
 r as (select w.*, case when not cut or u = '' then src else coalesce(whole, case when starts_with(u, 'les deux') then 'Les deux' when starts_with(u, 'der') then 'Der' when starts_with(u, 'the') then 'The' when starts_with(u, 'les') then 'Les' end,
   nullif(trim(regexp_replace(stem, '[\s(\[{{,\-–—/]+\S*$', '')), ''), stem) end repaired from w left join best using (host, u))"""


@query(rf"""with p as (select page_id, {_HOST} host, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) title, url from pages),
 t as (select page_id, host, trim(case when contains(url, '?') then substr(title, 1, 20) || '...' else title end) src from p), {_REPAIR} select page_id, repaired from r""")
def title_prefix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of addresses with a query are cut here, as the tables have none that are."""
    cut = F.when(F.contains(F.col("url"), F.lit("?")), F.concat(F.substring("title", 1, 20), F.lit("..."))).otherwise(F.col("title"))
    rows = page_titles(spark, sf_dir).select("page_id", host(F.col("url")).alias("host"), cut.alias("title"))
    return processing.repair_titles(rows, "host", "title", _KNOWN).select("page_id", "repaired")


def _sql_season(x: str) -> str:
    named = r"(?i)\b(summer|fall|spring|winter)\s*(?:intern(?:ship)?\s*)?(20\d\d)\b"
    return rf"case when regexp_matches({x}, '{named}') then lower(regexp_extract({x}, '{named}', 1)) || '-' || regexp_extract({x}, '{named}', 2) else coalesce(list_filter(regexp_extract_all({x}, '\b(20\d\d)\b', 1), lambda y: y::int between {NOW.year} and {NOW.year + 3})[1], 'ongoing') end"


def _distinct_words(x: str, pattern: str) -> str:
    return rf"len(list_distinct(regexp_extract_all(lower({x}), '\b(?:{pattern})\b')))"


@query(rf"""with p as (select page_id k, url, {_HOST} host, coalesce(html, '') html, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) title from pages),
 t as (select *, {_CLEAN("case when contains(url, '?') then substr(title, 1, 20) || '...' when k % 5 = 0 then title || ' Summer 2027' else title end")} src, {_CLEAN("html")} body from p), {_REPAIR},
 s as (select *, {_sql_season("repaired")} said, regexp_extract(trim(url), '^(?i)https?://[^/?#]*/([a-z]+)', 1) place, repaired || case when k % 9 = 0 then ' der' else '' end about from r),
 x as (select *, case when place = '' then 'Unspecified' else place end "location", {_distinct_words("body", WORDS.strong)} "domain", {_distinct_words("body", WORDS.stack)} stack, {_distinct_words("body", WORDS.business)} business from s),
 y as (select *, case when regexp_matches(about, '(?i)\b(?:{WORDS.strong})\b') then 'title' when regexp_matches(about, '(?i)\b(?:{WORDS.business})\b') then 'business-function' when regexp_matches(about, '(?i)\b(?:{"|".join(WORDS.categories.values())})\b') then 'title' when trim(body) = '' then 'no-evidence' else 'description' end basis,
   least("domain", 3) * 3 + least(stack, 6) - 2 * business >= 4 and stack >= 2 as enough from x),
 z as (select *, basis = 'title' or (basis = 'description' and enough) as technical from y),
 d as (select *, case when k % 17 = 0 then 'prospect' when k % 4 > 0 and not regexp_matches(repaired, '(?i)\b(?:{WORDS.lifecycle})\b') then 'not-early-career' when url is null or host = '' or not regexp_matches(trim(url), '^(?i)https:') then 'invalid-application-url'
   when host in ({", ".join(f"'{a}'" for a in AGGREGATORS)}) then 'aggregator-destination' when technical then 'source-policy' else 'nontechnical' end reason from z)
 select k page_id, host company, repaired title, repaired <> src title_repaired, "location", case when said <> 'ongoing' then said when k % 3 = 0 then 'fall-2026' else {_sql_season("body")} end season, case when said = 'ongoing' and k % 6 = 0 then 'source-default' end season_source,
   case when k % 8 = 0 then 'hybrid' when regexp_matches("location" || ' ' || body, '(?i)remote') then 'remote' when regexp_matches("location" || ' ' || body, '(?i)hybrid') then 'hybrid' when regexp_matches("location" || ' ' || body, '(?i)on.?site|in.?person') then 'onsite' end work_mode,
   k % 10 = 0 as citizenship, technical, basis, case when reason in ('prospect', 'not-early-career') then 'filtered' when reason in ('aggregator-destination', 'invalid-application-url') then 'withheld' when reason = 'source-policy' then 'included' else 'shelved' end outcome, reason from d""")
def processed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as postings of their hosts, with every column of a posting given on some of them."""
    key, none = F.col("page_id"), F.lit(None)
    title = F.when(F.contains(F.col("url"), F.lit("?")), F.concat(F.substring("title", 1, 20), F.lit("..."))).when(key % 5 == 0, F.concat("title", F.lit(" Summer 2027"))).otherwise(F.col("title"))
    rows = page_titles(spark, sf_dir).select(
        "page_id", F.lit("pages").alias("source_id"), key.alias("external_id"), F.coalesce(host(F.col("url")), F.lit("")).alias("company"), title.alias("title"), F.array(F.struct(F.lit("html").alias("format"), F.coalesce("html", F.lit("")).alias("value"))).alias("content"),
        F.array(F.regexp_extract(F.trim("url"), r"^(?i)https?://[^/?#]*/([a-z]+)", 1)).alias("locations"), F.when(key % 3 == 0, "fall-2026").alias("season_hint"), F.when(key % 6 == 0, "source-default").alias("season_authority"), F.col("url").alias("apply_url"),
        F.when(key % 17 == 0, "prospect").otherwise("open").alias("state"), F.when(key % 4 == 0, "source").otherwise("title").alias("authority"), F.when(key % 9 == 0, F.array(F.lit("der"))).alias("tags"), F.when(key % 8 == 0, "Hybrid office").alias("declared_mode"),
        F.when(key % 10 == 0, True).alias("citizenship"), none.cast("boolean").alias("degree"), none.cast("string").alias("pay_text"),
    )
    out = processing.process_postings(rows, WORDS, _KNOWN, AGGREGATORS, NOW)
    return out.select("page_id", "company", "title", "title_repaired", "location", "season", "season_source", "work_mode", "citizenship", "technical", "basis", "outcome", "reason")


_BOARDS = """with u as (select page_id k, case page_id % 6 when 0 then 'https://boards.greenhouse.io/Token' || page_id % 9 || '/jobs/' || page_id when 1 then 'https://jobs.lever.co/Site' || page_id % 7 || '/' || page_id || '/apply'
   when 2 then 'https://www.job-boards.greenhouse.io/token' || page_id % 9 || '/jobs/x' when 3 then 'http://jobs.lever.co/site' || page_id % 7 when 4 then 'https://jobs.ashbyhq.com/Board%2E' || page_id % 5 || '/' || page_id || '/application' else url end url, page_id % 13 = 0 as own from pages),
 p as (select *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) path, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') h from u),
 r as (select *, case when h in ('boards.greenhouse.io', 'job-boards.greenhouse.io') and regexp_matches(path, '^/[^/]+/jobs/\\d+') then 'greenhouse' when h = 'jobs.lever.co' and regexp_matches(path, '^/[^/]+/[^/]+') then 'lever' end provider,
   lower(regexp_extract(path, '^/([^/]+)', 1)) token, case when h = 'jobs.lever.co' then regexp_extract(path, '^/[^/]+/([^/]+)', 1) else regexp_extract(path, '^/[^/]+/jobs/(\\d+)', 1) end posting from p),
 b as (select *, case when provider = 'greenhouse' and substr(token, 6)::int < 6 then 'g-' || token when provider = 'lever' and substr(token, 5)::int % 2 = 0 then 'l-' || token end board from r),
 a as (select *, case when own then 'provider-api' when board is not null and posting::int % 4 < 3 then 'reviewed-board' else 'unattributed' end basis,
   case k % 5 when 0 then 404 when 1 then 403 when 2 then 503 end status from b)
 select k page_id, provider, case when provider is not null then token end token, case when provider is not null then posting end posting_id, basis, case when own then 'direct' when basis = 'reviewed-board' then board end board_source,
   case when k % 6 = 4 then 'Board.' || k % 5 end ashby, case when k % 6 = 1 then 'site' || k % 7 end lever,
   case status when 404 then 'gone' when 403 then 'blocked' when 503 then 'unreachable' else case when k % 3 = 0 then 'blocked' else 'live' end end reach, status is distinct from 404 and (basis <> 'unattributed' or k % 2 = 0) as alert_eligible from a"""


@query(_BOARDS)
def board_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with addresses on boards: what they name, whether a reviewed board shows it, and what may alert."""
    key, text = F.col("page_id"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    url = (
        F.when(key % 6 == 0, text("https://boards.greenhouse.io/Token", key % 9, "/jobs/", key)).when(key % 6 == 1, text("https://jobs.lever.co/Site", key % 7, "/", key, "/apply")).when(key % 6 == 2, text("https://www.job-boards.greenhouse.io/token", key % 9, "/jobs/x"))
        .when(key % 6 == 3, text("http://jobs.lever.co/site", key % 7)).when(key % 6 == 4, text("https://jobs.ashbyhq.com/Board%2E", key % 5, "/", key, "/application")).otherwise(F.col("url"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("apply_url"), F.when(key % 13 == 0, "direct").otherwise("list").alias("source"))
    boards = spark.createDataFrame([(f"g-token{i}", "greenhouse", f"Token{i}") for i in range(6)] + [(f"l-site{i}", "lever", f"site{i}") for i in range(0, 7, 2)] + [("direct", "ashby", "x")], "source_id string, provider string, token string")
    named = pages.select(attribution.board_reference(F.col("apply_url")).alias("r"), "page_id").where("r is not null and page_id % 4 < 3")
    active = named.join(boards, (F.col("r.provider") == F.col("provider")) & (F.col("r.token") == F.lower("token"))).select("source_id", F.col("r.posting_id").alias("external_id"))
    out = attribution.with_attribution(pages, "apply_url", "source", boards, active)
    status = F.when(key % 5 == 0, 404).when(key % 5 == 1, 403).when(key % 5 == 2, 503)
    reach = attribution.reachability(status.isNotNull(), status, F.when(key % 3 == 0, F.array(F.lit("access restricted to scraper"))).otherwise(F.array().cast("array<string>")))
    ref = attribution.board_reference(F.col("apply_url"))
    return out.select(
        "page_id", ref["provider"].alias("provider"), ref["token"].alias("token"), ref["posting_id"].alias("posting_id"), "basis", "board_source", attribution.ashby_board(F.col("apply_url")).alias("ashby"), attribution.lever_site(F.col("apply_url")).alias("lever"),
        reach.alias("reach"), attribution.verified(F.col("basis"), reach, key % 2 == 0)["alert_eligible"].alias("alert_eligible"),
    )


_INDEXED = """with j as (select o_orderkey k, case o_orderkey % 3 when 0 then true when 1 then false end technical, o_orderstatus = 'O' as open, o_orderkey % 5 = 0 as baseline, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') d from orders),
 w as (select *, case when coalesce(technical, true) and open then 'OPEN' end open_pk, case when coalesce(technical, true) and open then case when baseline then '1' else '3' end || '#' || d || '#' || k end open_sk,
   case when coalesce(technical, true) and not open then 'CLOSED' end closed_pk, case when coalesce(technical, true) and not open then d || '#' || k end closed_sk from j),
 s as (select *, case when k % 11 = 0 then 'OPEN' else open_pk end s_open, case when k % 13 = 0 then null else closed_sk end s_closed from w)"""


@query(f"""{_INDEXED} select k o_orderkey, case when s_open is not distinct from open_pk and s_closed is not distinct from closed_sk then null when not coalesce(technical, true) then 'nontechnical' when open then 'openTechnical' else 'closedTechnical' end kind from s""")
def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs with index keys, some of which are broken here, and the kind of what does not match."""
    key, c = F.col("o_orderkey"), F.col
    technical, opened = F.when(key % 3 == 0, True).when(key % 3 == 1, False), c("o_orderstatus") == "O"
    wanted = versions.index_keys(technical, opened, key % 5 == 0, c("o_orderdate"), c("o_orderdate"), key)
    jobs = table(spark, sf_dir, "orders").withColumns(wanted)
    broken = jobs.withColumns({"open_pk": F.when(key % 11 == 0, "OPEN").otherwise(c("open_pk")), "closed_sk": F.when(key % 13 == 0, None).otherwise(c("closed_sk"))})
    return broken.select("o_orderkey", versions.index_mismatch(wanted, technical, opened).alias("kind"))


@query("""with recursive a as (select o_custkey, o_orderkey, nth, length(o_orderpriority || ' · ' || o_orderkey || chr(10) || 'Source: ' || o_orderstatus) + 2 size from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) nth from orders) where nth between 6 and 10),
 r as (select o_custkey, o_orderkey, nth, size::bigint as total, 0 chunk from a where nth = 6
   union all select a.o_custkey, a.o_orderkey, a.nth, case when r.total + a.size > 80 then a.size else r.total + a.size end, case when r.total + a.size > 80 then r.chunk + 1 else r.chunk end from r join a on a.o_custkey = r.o_custkey and a.nth = r.nth + 1)
 select o_custkey, o_orderkey, chunk::int chunk from r""")
def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's alerts of each customer beyond those sent singly, in summaries of 80 letters; ten a run are the feature."""
    buckets = delivery.alert_buckets(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).where("bucket = 'chunk'")
    body = messages.render("{priority} · {key}\n\nSource: {status}", {"priority": F.col("o_orderpriority"), "key": F.col("o_orderkey"), "status": F.col("o_orderstatus")})
    return messages.summary_chunks(buckets.withColumn("body", body), "o_custkey", "nth", "o_orderkey", "body", 80)


_SHORT = {"the": "T", "der": "D", "under": "U", "les": "L"}


@query(r"""with t as (select page_id, trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1), '[\r\n\t]+', ' ', 'g')) title from pages),
 h as (select *, list_sort(list_filter([""" + ", ".join(f"case when contains(lower(title), '{k}') then {{'p': strpos(lower(title), '{k}')::int, 'l': {-len(k)}, 's': '{v}'}} end" for k, v in _SHORT.items()) + r"""], lambda x: x is not null)) hits from t)
 select page_id, coalesce(hits[1].s, nullif(trim(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\b(?:internship|intern|co-op)\b', '', 'g'), '[\s–—-]+$', ''), '\s{2,}', ' ', 'g')), ''), title) short from h""")
def compact_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_titles(spark, sf_dir).select("page_id", messages.compact_title(F.col("title"), _SHORT).alias("short"))


_COMPANY = "regexp_replace(trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '( (co|inc|llc))+$', '')"


@query(f"""with feeds as (select case c_custkey % 3 when 0 then c_mktsegment || ' ' || c_nationkey % 7 || ', Inc.' when 1 then '* ' || lower(c_mktsegment) || '-' || c_nationkey % 7 else c_mktsegment || ' & ' || c_nationkey % 7 || ' Co LLC' end name, o_orderstatus source_id, o_orderpriority season, null provider, null status, 1 listings
   from orders join customer on c_custkey = o_custkey),
 boards as (select case s_suppkey % 5 when 0 then 'Building ' when 1 then 'Machinery ' when 2 then 'Household ' when 3 then 'Other & ' else 'New ' end || s_nationkey % 7 name, 's' || s_suppkey source_id, null season, case when s_suppkey % 2 = 0 then 'lever' else 'ashby' end provider, case when s_acctbal > 5000 then 'published' else 'shadow' end status, 0 listings from supplier),
 seeds as (select n_name || ' seed' name, null, null, null, null, 0 from nation),
 k as (select *, {_COMPANY} k from (select * from feeds union all select * from boards union all select * from seeds)),
 c as (select *, replace(case k when 'building 1' then 'household 1' when 'machinery 1' then 'household 1' else k end, ' ', '-') company_id from k)
 select company_id, case when bool_or(coalesce(status = 'published', false)) then 'direct-published' when bool_or(coalesce(status = 'shadow', false)) then 'direct-shadow' when sum(listings) > 0 then 'feed-observed' else 'candidate-only' end state, sum(listings)::bigint listings,
   array_to_string(list_sort(list_distinct(coalesce(list(source_id) filter (listings > 0), []))), ',') source_ids, array_to_string(list_sort(list_distinct(coalesce(list(season) filter (listings > 0), []))), ',') seasons, count(distinct trim(name))::int n_names,
   array_to_string(list_sort(list_distinct(coalesce(list(provider || ':' || source_id || ':' || status) filter (provider is not null), []))), ',') direct_sources from c group by 1""")
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies over orders as feeds, suppliers as boards and nations as seeds; three names lead to one by two aliases."""
    c, key, nation = F.col, F.col("c_custkey"), F.col("c_nationkey") % 7
    name = F.when(key % 3 == 0, F.concat("c_mktsegment", F.lit(" "), nation, F.lit(", Inc."))).when(key % 3 == 1, F.concat(F.lit("* "), F.lower("c_mktsegment"), F.lit("-"), nation)).otherwise(F.concat("c_mktsegment", F.lit(" & "), nation, F.lit(" Co LLC")))
    customers = table(spark, sf_dir, "customer").select(key.alias("o_custkey"), name.alias("name"))
    feeds = table(spark, sf_dir, "orders").join(customers, "o_custkey").select("name", c("o_orderstatus").alias("source_id"), c("o_orderpriority").alias("season"), F.lit(1).alias("listings"))
    kind = F.get(F.array(*map(F.lit, ("Building ", "Machinery ", "Household ", "Other & ", "New "))), (c("s_suppkey") % 5).cast("int"))
    boards = table(spark, sf_dir, "supplier").select(F.concat(kind, c("s_nationkey") % 7).alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.when(c("s_suppkey") % 2 == 0, "lever").otherwise("ashby").alias("provider"), F.when(c("s_acctbal") > 5000, "published").otherwise("shadow").alias("status"))
    seeds = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" seed")).alias("name"), F.lit(True).alias("seed"))
    aliases = spark.createDataFrame([("BUILDING 1", "Machinery, 1"), ("machinery 1", "Household 1 Inc")], "alias string, name string")
    out = coverage.company_coverage(coverage.observations(feeds, boards, seeds), aliases)
    joined = lambda n: F.coalesce(F.array_join(n, ","), F.lit("")).alias(n)
    return out.select("company_id", "state", "listings", joined("source_ids"), joined("seasons"), F.size("names").alias("n_names"), joined("direct_sources"))


_NOW_SECONDS = 883612800  # 1998-01-01


@query(f"""with snaps as (select o_custkey k, 'r' || o_orderkey % 50 run, floor(epoch(o_orderdate))::bigint done, o_orderkey o, o_orderkey % 7 eligible, o_orderkey % 9 withheld, o_orderkey % 10 + 5 raw, o_orderkey % 7 + case when o_orderkey % 23 = 0 then 1 else 0 end checked, o_orderkey % 3 failed, o_orderpriority p from orders),
 told as (select k, run, list_filter([case when p = '5-LOW' then 'not-succeeded' end, case when o % 17 = 0 then 'not-complete' end, case when o % 19 = 0 then 'identity-unverified' end, case when o % 29 = 0 then 'schema-invalid' end, case when eligible + withheld > raw then 'more-rows-than-raw' end,
   case when checked <> eligible then 'links-not-checked-once' end, case when failed > checked then 'more-failures-than-links' end, case when checked > 0 and failed > 0.2 * checked then 'link-failure-rate' end], lambda x: x is not null) b, done from snaps),
 sums as (select k, count(*) n, count(distinct run) n_runs, min(done) f, max(done) l, list_sort(flatten(list(list_transform(b, lambda x: run || ': ' || x)))) told from told group by 1),
 src as (select c_custkey k, c_custkey % 3 > 0 published, c_custkey % 10 < 9 given, case when c_custkey % 7 > 0 then 'owner' else ' ' end who, case when c_custkey % 5 > 0 then {_NOW_SECONDS} - 86400 * (c_custkey % 400 - 20) end approved, c_custkey % 4 = 0 as has,
   case when c_custkey % 8 > 0 then 'late' else '' end reason from customer),
 x as (select *, case when has and k % 12 > 0 then coalesce(approved, {_NOW_SECONDS}) + 86400 * (k % 600 - 20) end until from src),
 y as (select x.*, coalesce(n, 0) n, n_runs, f, l, told, has and until is not null and not coalesce(until <= approved, false) and until > {_NOW_SECONDS} as active from x left join sums using (k)),
 h as (select *, list_filter([case when trim(who) = '' then 'no-approver' end, case when approved is null then 'approval-time-invalid' end, case when approved > {_NOW_SECONDS} + 300 then 'approved-in-future' end, case when k % 11 = 0 then 'baseline-not-approved' end, case when k % 13 = 0 then 'identity-not-stable' end, case when k % 17 = 0 then 'hosts-not-stable' end,
   case when has and reason = '' then 'override-without-reason' end, case when has and until is null then 'override-time-invalid' end, case when has and until <= approved then 'override-before-approval' end, case when has and not coalesce(until <= approved, false) and until <= {_NOW_SECONDS} then 'override-overdue' end,
   case when n < case when active then 1 else 3 end then 'too-few-snapshots' end], lambda v: v is not null) head from y)
 select 's' || k source_id, array_to_string(case when not published then []::varchar[] when not given then ['no-evidence'] when list_contains(head, 'too-few-snapshots') then head else list_concat(head, list_filter([case when not active and l - f < 86400 then 'span-too-short' end,
   case when l > {_NOW_SECONDS} + 300 then 'snapshot-in-future' end, case when approved < l then 'approved-before-snapshot' end, case when n_runs < n then 'runs-not-unique' end], lambda v: v is not null), told) end, ',') violations from h""")
def promotion_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources with evidence, their orders as its snapshots; every rule is broken by some."""
    c, k, o, now = F.col, F.col("c_custkey"), F.col("o_orderkey"), _NOW_SECONDS
    name = F.concat(F.lit("s"), k)
    approved = F.when(k % 5 > 0, F.lit(now) - 86400 * (k % 400 - 20))
    has = k % 4 == 0
    customers = table(spark, sf_dir, "customer")
    sources = customers.select(name.alias("source_id"), F.when(k % 3 > 0, "published").otherwise("shadow").alias("status"))
    promotions = customers.where(k % 10 < 9).select(
        name.alias("source_id"), F.when(k % 7 > 0, "owner").otherwise(" ").alias("approved_by"), approved.alias("approved_at"), (k % 11 > 0).alias("quiet_baseline"), (k % 13 > 0).alias("stable_identity"), (k % 17 > 0).alias("stable_hosts"),
        F.when(has, F.when(k % 8 > 0, "late").otherwise("")).alias("override_reason"), F.when(has & (k % 12 > 0), F.coalesce(approved, F.lit(now)) + 86400 * (k % 600 - 20)).alias("override_until"),
    )
    snapshots = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.concat(F.lit("r"), o % 50).alias("run_id"), health.epoch_seconds("o_orderdate").alias("completed_at"), (c("o_orderpriority") != "5-LOW").alias("succeeded"), (o % 17 > 0).alias("complete"), (o % 19 > 0).alias("identity_verified"), (o % 29 > 0).alias("schema_valid"),
        (o % 10 + 5).alias("raw_rows"), (o % 7).alias("eligible_rows"), (o % 9).alias("withheld_rows"), (o % 7 + F.when(o % 23 == 0, 1).otherwise(0)).alias("links_checked"), (o % 3).alias("link_failures"),
    )
    return promotion.promotion_violations(sources, promotions, snapshots, now).select("source_id", F.array_join("violations", ",").alias("violations"))
