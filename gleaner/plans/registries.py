"""Queries of registry gates, sightings and seeding on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import occurrences, registry
from gleaner.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_NOW, _DAY = 883612800, 86400  # 1998-01-01


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as boards of a registry and suppliers as boards that wait: (folder, k, nation)."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("folder"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("folder"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return customers.where("k % 10 < 9").unionByName(suppliers)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), F.col
    return table(spark, sf_dir, "customer").select(
        F.when(k % 17 == 0, F.concat(F.lit("lever-s"), k - 1)).when(k % 13 == 0, F.concat(F.lit("other-s"), k)).otherwise(F.concat(F.lit("lever-s"), k)).alias("source_id"),
        k.alias("position"), F.concat(F.lit("s"), F.when(k % 19 == 0, k - 1).otherwise(k)).alias("board"), F.concat(F.lit("Company "), "c_nationkey").alias("company"),
        F.concat(F.lit("https://www.c"), "c_nationkey", F.lit(".com/careers")).alias("careers_url"), F.when(k % 23 > 0, F.lit(_NOW) - _DAY * (k % 200)).cast("long").alias("admitted_at"), F.lit("global").alias("region"),
        F.when(c("c_acctbal") > 0, "published").otherwise("shadow").alias("status"), F.when(k % 7 == 0, "legacy-review").otherwise("agent-verified").alias("evidence_status"),
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k, n = F.col("folder"), F.col("k"), F.col("nation")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return _boards(spark, sf_dir).select(
        f, (k % 53 == 0).alias("malformed"), F.when(k % 29 == 0, text("Bad_", k)).when(k % 31 == 0, text(f, "x")).otherwise(f).alias("board"),
        F.when(k % 37 == 0, " ").when(k % 41 == 0, "Else").otherwise(text("Company ", n)).alias("company"),
        F.when(k % 11 == 0, text("http://www.c", n, ".com/careers")).when(k % 12 == 5, "https://careers.linkedin.com/x").otherwise(text("https://www.c", n, ".com/careers")).alias("careers_url"),
        F.when(k % 14 == 3, "https://jobs.other.co.uk/x").otherwise(text("https://www.c", n, ".com/join")).alias("page_url"),
        F.when(k % 15 == 4, None).when(k % 16 == 1, text('<a href="https://jobs.lever.co/', f, '-2">')).when(k % 18 == 2, F.repeat(F.lit("x"), F.lit(2001))).otherwise(text('<a href="https://jobs.LEVER.co/', f, '">Jobs</a>')).alias("excerpt"),
        F.when(k % 20 == 6, text("http://jobs.lever.co/", f, "/1")).when(k % 20 == 7, text("https://boards.lever.co/", f, "/1")).when(k % 20 == 8, text("https://jobs.lever.co/", f)).otherwise(text("https://jobs.lever.co/", f, "/id", k, "/apply")).alias("job_url"),
        F.when(k % 21 == 9, F.array().cast("array<string>")).when(k % 21 == 10, F.array(F.lit("jobs.lever.co"), F.lit("x.com"))).otherwise(F.array(F.lit("JOBS.lever.co"))).alias("hosts"),
        F.when(k % 43 == 0, "eu").otherwise("global").alias("region"), F.when(k % 6 == 1, "custom-host-review").when(k % 47 == 0, "odd").otherwise("ownership-verified").alias("state"),
        F.when(k % 25 > 0, F.lit(_NOW) - _DAY * (k % 200) + F.when(k % 26 == 0, 1).otherwise(0)).cast("long").alias("verified_at"), F.when(k % 3 == 0, "why").alias("notes"),
    )


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = F.col("folder"), F.col("k")
    probes = _boards(spark, sf_dir).where("k % 8 > 0").select(
        f, (k % 49 == 0).alias("malformed"), F.when(k % 46 == 0, "zz").otherwise(f).alias("board"), F.when(k % 9 == 4, "http-error").otherwise("ok").alias("state"), F.when(k % 27 == 0, "known").otherwise("unattributed").alias("attribution"),
        F.when(k % 33 == 0, "eu").otherwise("global").alias("region"), F.when(k % 36 == 0, None).otherwise(F.when(k % 35 == 0, 1).otherwise(0)).cast("long").alias("url_violations"), F.when(k % 38 == 0, 2).otherwise(0).cast("long").alias("malformed_rows"),
        F.when(k % 39 == 0, None).when(k % 39 == 1, F.array(F.lit("x.com"))).otherwise(F.array(F.lit("jobs.lever.co"))).alias("hosts"), F.when(k % 44 == 0, 2).otherwise(1).cast("long").alias("n_results"), F.when(k % 45 > 0, 1).cast("long").alias("probed_at"),
    )
    bare = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("folder"))
    return probes.unionByName(bare, allowMissingColumns=True)


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 28 > 0").select(F.concat(F.lit("lever-s"), k).alias("source_id"), F.when(k % 34 == 0, "other").otherwise("lever").alias("source_class"), F.when(k % 32 > 0, F.concat(F.lit("s"), k)).alias("board"))


def _listed(*rules: str) -> str:
    return "list_filter([" + ", ".join("case when {1} then '{0}' end".format(*r.split(": ", 1)) for r in rules) + "], lambda v: v is not null)"


_MANIFEST = f"""with u as (select 's' || c_custkey folder, c_custkey k, c_nationkey n from customer where c_custkey % 10 < 9 union all select 't' || s_suppkey, s_suppkey, s_nationkey from supplier),
 reg as (select case when c_custkey % 17 = 0 then 'lever-s' || (c_custkey - 1) when c_custkey % 13 = 0 then 'other-s' || c_custkey else 'lever-s' || c_custkey end source_id, c_custkey "position", 's' || case when c_custkey % 19 = 0 then c_custkey - 1 else c_custkey end board,
   'Company ' || c_nationkey company, 'https://www.c' || c_nationkey || '.com/careers' careers_url, case when c_custkey % 23 > 0 then {_NOW} - {_DAY} * (c_custkey % 200) end admitted_at, case when c_acctbal > 0 then 'published' else 'shadow' end status, c_custkey % 7 = 0 legacy from customer),
 e as (select *, case when k % 29 = 0 then 'Bad_' || k when k % 31 = 0 then folder || 'x' else folder end board, case when k % 37 = 0 then ' ' when k % 41 = 0 then 'Else' else 'Company ' || n end company, case when k % 11 = 0 then 'http' when k % 12 = 5 then 'foreign' else 'own' end careers,
   case when k % 11 = 0 then 'http://www.c' || n || '.com/careers' when k % 12 = 5 then 'https://careers.linkedin.com/x' else 'https://www.c' || n || '.com/careers' end careers_url, case when k % 15 = 4 then 'none' when k % 16 = 1 then 'other' when k % 18 = 2 then 'long' else 'good' end ex,
   case when k % 20 = 6 then 'http' when k % 20 = 7 then 'host' when k % 20 = 8 then 'board' else 'good' end job, case when k % 6 = 1 then 'custom-host-review' when k % 47 = 0 then 'odd' else 'ownership-verified' end state,
   case when k % 25 > 0 then {_NOW} - {_DAY} * (k % 200) + case when k % 26 = 0 then 1 else 0 end end verified_at from u),
 ev as (select *, case when k % 53 = 0 then ['evidence-malformed'] else {_listed("board-invalid: k % 29 = 0", "state-unknown: state = 'odd'", "no-company: company = ' '", "region-unsupported: k % 43 = 0", "verified-time-invalid: verified_at is null", "careers-not-https: careers = 'http'", "careers-foreign: careers = 'foreign'",
   "page-of-other-domain: careers <> 'http' and (careers = 'foreign' or k % 14 = 3)", "no-excerpt: ex = 'none' and state = 'ownership-verified'", "neither-excerpt-nor-notes: ex = 'none' and state <> 'ownership-verified' and k % 3 > 0", "excerpt-too-long: ex = 'long'",
   "excerpt-without-board: ex = 'other' or (ex = 'good' and board <> folder)", "job-not-https: job = 'http'", "job-on-other-host: job = 'host'", "job-not-on-board: job = 'board' or (job = 'good' and board <> folder)", "no-hosts: k % 21 = 9", "hosts-outside: k % 21 = 10 and state <> 'custom-host-review'")} end rules from e),
 p as (select folder, k, case when k % 49 = 0 then 'probe-malformed' when k % 45 = 0 then 'probe-time-invalid' when k % 27 = 0 then 'probe-attributed' when k % 44 = 0 then 'probe-not-one-result' end unread, k % 9 = 4 bad, k % 46 = 0 other,
   {_listed("probe-region: k % 33 = 0", "probe-url-violations: k % 36 = 0 or k % 35 = 0", "probe-malformed-rows: k % 38 = 0", "probe-without-hosts: k % 39 = 0", "probe-hosts-outside: k % 39 = 1")} rest from u where k % 8 > 0),
 pol as (select 'lever-s' || c_custkey source_id, case when c_custkey % 34 = 0 then 'other' else 'lever' end class, case when c_custkey % 32 > 0 then 's' || c_custkey end board from customer where c_custkey % 28 > 0),
 joined as (select r.*, min(r."position") over (partition by r.source_id) fi, min(r."position") over (partition by r.board) fb, pol.source_id ps, pol.class pc, pol.board pb, ev.folder ef, ev.k ek, ev.rules, ev.state, ev.board eb, ev.company ec, ev.careers_url eu, ev.verified_at et, p.folder pf, p.unread, p.bad, p.other, p.rest
   from reg r left join pol on pol.source_id = r.source_id left join ev on ev.folder = r.board left join p on p.folder = r.board),
 told as (select source_id subject, {_listed('duplicate-id: "position" > fi', 'duplicate-board: "position" > fb', "id-not-namespaced: not starts_with(source_id, 'lever-')", "no-policy: ps is null", "policy-class: pc <> 'lever'", "policy-board: pc = 'lever' and pb is distinct from board", "admission-time-invalid: admitted_at is null",
   f"verification-overdue: floor(({_NOW} - admitted_at) / {_DAY}) > 180")} head, case when legacy then [] when ef is null then ['no-evidence'] else list_concat(case when pf is null then ['no-probe'] else [] end, rules, case when ek % 53 = 0 then [] else list_concat(
   {_listed("not-admissible: state <> 'ownership-verified'", "other-board: eb <> board", "other-company: ec <> company", "other-careers: eu <> careers_url", "other-region: ek % 43 = 0", "other-time: coalesce(et <> admitted_at, true)")},
   case when pf is null then [] when unread is not null then [unread] else list_concat({_listed("probe-of-other-board: other", "probe-not-ok: bad")}, case when bad then [] else rest end) end) end) end tail from joined),
 free as (select ev.folder subject, case when ev.k % 53 = 0 then rules else list_concat({_listed("other-folder: ev.board <> ev.folder")}, rules, case when p.folder is null then ['no-probe'] when unread is not null then [unread] else list_concat({_listed("probe-of-other-board: other", "probe-not-ok: bad and state = 'ownership-verified'")},
   case when not bad and state = 'ownership-verified' then rest else [] end) end) end v from ev left join p on p.folder = ev.folder where ev.folder not in (select board from reg))
"""


@query(f"""{_MANIFEST} select subject, array_to_string(list_concat(head, tail), ',') violations from told union all select source_id, 'policy-without-source' from pol where class = 'lever' and source_id not in (select source_id from reg)
 union all select subject, array_to_string(v, ',') from free union all select 'p' || n_nationkey, 'folder-without-evidence' from nation
 union all select folder, 'folder-without-evidence' from p where folder not in (select folder from ev) and folder not in (select board from reg)""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a registry with evidence, probes and policies, suppliers as evidence that waits; every rule is broken by some."""
    found = registry.manifest_violations(_registry(spark, sf_dir), _evidence(spark, sf_dir), _probes(spark, sf_dir), _policies(spark, sf_dir), _NOW)
    return found.select("subject", F.array_join("violations", ",").alias("violations"))


@query(f"""{_MANIFEST}, waiting as (select count(*) n from ev where state = 'ownership-verified' and len(rules) = 0 and folder not in (select board from reg))
 select count(*) reviewed, count_if(status = 'published')::bigint published, count_if(status = 'shadow')::bigint shadow, count_if(not legacy)::bigint agent_verified, count_if(legacy)::bigint legacy_review, (select n from waiting) pending from reg""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.manifest_summary(_registry(spark, sf_dir), _evidence(spark, sf_dir))


@query(f"""{_MANIFEST} select 'lever-' || board source_id, board, company, careers_url, verified_at::bigint admitted_at, 'global' region, 'shadow' status, 'agent-verified' evidence_status from ev where state = 'ownership-verified' and len(rules) = 0 and folder not in (select board from reg)""")
def pending_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that waits for a registry row, as the row that it would become."""
    return registry.pending_admission(_registry(spark, sf_dir), _evidence(spark, sf_dir))


@query("""select 'b' || page_id folder, case when page_id % 7 = 0 then 'malformed-record' when page_id % 5 = 0 then 'transport-error' when page_id % 5 = 1 then 'http-error' else 'ok' end state,
 case when page_id % 7 = 0 or page_id % 5 < 2 then null when page_id % 4 = 0 then 'missing' when page_id % 3 = 0 then 'exact' else 'link-only' end fidelity, case when page_id % 7 = 0 or page_id % 5 < 2 then null else page_id % 4 > 0 end still_proven from pages""")
def evidence_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts against whole pages: gone, in other words, or as recorded but for white space."""
    k, c = F.col("page_id"), F.col
    board, url = F.concat(F.lit("b"), k), F.concat(F.lit("https://www.example.com/"), k)
    link = lambda text: F.concat(F.lit('<a href="https://jobs.lever.co/'), board, F.lit(f'">{text}</a>'))
    pages = table(spark, sf_dir, "pages")
    html = F.concat(F.coalesce("html", F.lit("")), F.when(k % 4 > 0, F.concat(F.lit("\n"), link("see our\n  open   roles"))).otherwise(F.concat(F.lit(" https://jobs.lever.co/"), board, F.lit("-2"))))
    evidence = pages.select(
        board.alias("folder"), F.lit(False).alias("malformed"), board.alias("board"), F.when(k % 7 > 0, "Example").alias("company"), F.lit("https://example.com/careers").alias("careers_url"), url.alias("page_url"),
        F.when(k % 3 == 0, link("see our open roles")).otherwise(link("roles")).alias("excerpt"), F.concat(F.lit("https://jobs.lever.co/"), board, F.lit("/1")).alias("job_url"), F.array(F.lit("jobs.lever.co")).alias("hosts"),
        F.lit("global").alias("region"), F.lit("ownership-verified").alias("state"), F.lit(1).cast("long").alias("verified_at"), F.lit(None).cast("string").alias("notes"),
    )
    fetched = pages.select(url.alias("page_url"), F.when(k % 5 == 0, None).otherwise(F.when(k % 5 == 1, 404).otherwise(200)).alias("status"), html.alias("html"))
    return registry.recheck(evidence, fetched).select("folder", c("state"), "fidelity", "still_proven")


@query(r"""with r as (select s_suppkey k, case when s_suppkey % 31 = 0 then 'Tok' || s_suppkey when s_suppkey % 23 = 0 then 'tok' || (s_suppkey - 1) else 'tok' || s_suppkey end token, s_name, s_acctbal from supplier),
 x as (select *, case when k % 29 = 0 then 'greenhouse-x' when k % 37 = 0 then 'greenhouse-tok' || (k - 1) else 'greenhouse-' || token end source_id, count(*) over (partition by token) nt from r), y as (select *, count(*) over (partition by source_id) ni from x)
 select source_id, token, error from (select *, coalesce(case when k % 31 = 0 then 'token-invalid' end, case when source_id <> 'greenhouse-' || token then 'id-not-of-token' end, case when k % 11 = 0 then 'no-aliases' end, case when k % 13 = 0 then 'careers-invalid' when k % 17 = 0 then 'careers-not-https' end,
   case when k % 19 = 0 then 'admitted-name' end, case when k % 41 = 0 then 'admission-time' end, case when k % 14 = 0 then 'no-final-hosts' end, case when k % 16 = 0 then 'host-not-bare' end, case when s_acctbal < 0 and k % 2 = 0 then 'host-without-reason' end, case when k % 43 = 0 then 'status' end, case when ni > 1 then 'duplicate-id' end, case when nt > 1 then 'duplicate-token' end) error from y) where error is not null""")
def registry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boards with tokens, some of which break a rule or repeat another's token."""
    k, c, hosts = F.col("s_suppkey"), F.col, lambda *h: F.array(*map(F.lit, h))
    token = F.when(k % 31 == 0, F.concat(F.lit("Tok"), k)).when(k % 23 == 0, F.concat(F.lit("tok"), k - 1)).otherwise(F.concat(F.lit("tok"), k))
    rows = table(spark, sf_dir, "supplier").withColumn("token", token).select(
        F.when(k % 29 == 0, "greenhouse-x").when(k % 37 == 0, F.concat(F.lit("greenhouse-tok"), k - 1)).otherwise(F.concat(F.lit("greenhouse-"), "token")).alias("source_id"), "token", c("s_name").alias("employer_id"), c("s_name").alias("display_name"),
        F.when(k % 11 > 0, F.array("s_name")).otherwise(F.array().cast("array<string>")).alias("aliases"), F.when(k % 13 == 0, "careers").when(k % 17 == 0, "http://x.com/").otherwise("https://x.com/").alias("careers_url"),
        F.array(F.lit("Élse, Inc."), F.upper("s_name")).alias("expected_names"), F.when(k % 19 == 0, F.concat("s_name", F.lit(" Inc"))).when(k % 2 == 0, "ELSE inc").otherwise(F.replace("s_name", F.lit("#"), F.lit(" - "))).alias("admitted_name"),
        F.when(k % 41 == 0, "2026-13-01T00:00:00Z").otherwise("2026-07-27T21:13:00.000Z").alias("admitted_at"), hosts("boards.greenhouse.io").alias("initial_hosts"),
        F.when(k % 14 == 0, F.array().cast("array<string>")).when(k % 16 == 0, hosts("x.com/y")).when(c("s_acctbal") < 0, hosts("careers.x.com")).otherwise(hosts("Job-Boards.greenhouse.io")).alias("final_hosts"), F.when(k % 2 == 1, "own host").alias("host_reason"),
        F.when(k % 43 == 0, "draft").otherwise("shadow").alias("status"), F.when(k % 3 == 0, "reviewed").alias("evidence_status"),
    )
    return registry.registry_errors(rows)


@query(r"""with q as (select distinct case c_custkey % 4 when 0 then ' greenhouse-' || lower(n_name) when 1 then replace(n_name, ' ', '-') || ', LLC' when 2 then 'R ' || n_regionkey || ' Corp' else c_mktsegment end query from customer join nation on n_nationkey = c_nationkey),
 k as (select *, regexp_replace(trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), '( (llc|corp))+$', '') key from q),
 names as (select distinct 'greenhouse-' || lower(n_name) source_id, unnest([trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), 'r ' || n_regionkey]) key from nation),
 n as (select key, count(*) n, min(source_id) s from names group by 1)
 select query, case when i.source_id is not null or n.n = 1 then 'found' when n.n > 1 then 'ambiguous' else 'unknown' end status, coalesce(i.source_id, case when n.n = 1 then n.s end) source_id, (case when i.source_id is not null then 1 else coalesce(n.n, 0) end)::bigint n_candidates
 from k left join (select distinct source_id from names) i on i.source_id = trim(k.query) left join n on n.key = k.key""")
def reviewed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as reviewed sources, looked up by id, name, or the employer that a region's nations share."""
    nations = table(spark, sf_dir, "nation")
    sources = nations.select(F.concat(F.lit("greenhouse-"), F.lower("n_name")).alias("source_id"), F.concat("n_name", F.lit(", Inc.")).alias("display_name"), F.concat(F.lit("r "), "n_regionkey").alias("employer_id"), F.array(F.concat("n_name", F.lit(" Co"))).alias("aliases"))
    k = F.col("c_custkey") % 4
    asked = F.when(k == 0, F.concat(F.lit(" greenhouse-"), F.lower("n_name"))).when(k == 1, F.concat(F.replace("n_name", F.lit(" "), F.lit("-")), F.lit(", LLC"))).when(k == 2, F.concat(F.lit("R "), "n_regionkey", F.lit(" Corp"))).otherwise(F.col("c_mktsegment"))
    queries = table(spark, sf_dir, "customer").join(nations.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(asked.alias("query"))
    return registry.find_reviewed(queries, sources)


_SIGHTED = """with occ as (select event_type source_id, user_id external_id, min(event_id) first_at, arg_min(event_id % 3, event_id) p from events group by 1, 2),
 act as (select distinct event_type source_id, user_id external_id from events where event_id % 2 = 0), o as (select occ.*, act.external_id is not null shown from occ left join act using (source_id, external_id)),
 mk as (select event_type source_id, max(event_id) h, max(event_id) filter (event_id % 3 = 0) live from events where event_type <> 'click' group by 1),
 c as (select o.*, case when shown then 'h' || h end confirmed_hash, case when shown and o.source_id <> 'error' then live when shown then h end confirmed_at from o left join mk using (source_id))"""


def _sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, c = table(spark, sf_dir, "events"), F.col
    keys = [c("event_type").alias("source_id"), c("user_id").alias("external_id")]
    occ = events.groupBy(*keys).agg(F.min("event_id").alias("first_at"), F.min_by(c("event_id") % 3, "event_id").alias("p"))
    marks = events.where("event_type <> 'click'").groupBy(c("event_type").alias("source_id"))
    checkpoints = marks.agg(F.concat(F.lit("h"), F.max("event_id")).alias("content_hash"), F.max("event_id").alias("last_success_at"))
    health = marks.agg(F.max(F.when(c("event_id") % 3 == 0, c("event_id"))).alias("last_success_at")).where("source_id <> 'error'")
    return occurrences.confirmed(occ, checkpoints, events.where("event_id % 2 = 0").select(*keys), health)


@query(f"{_SIGHTED} select source_id, external_id, confirmed_hash, confirmed_at from c")
def occurrence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in each kind of event, and when their last snapshot confirmed them."""
    return _sighted(spark, sf_dir).select("source_id", "external_id", "confirmed_hash", "confirmed_at")


_ATTRIBUTED = _SIGHTED + """, refs as (select user_id % 50 job, event_id, event_type source_id, case when event_id % 4 > 0 then user_id end external_id, case when event_id % 5 > 0 then 'd' || user_id % 9 end document, user_id % 7 "row" from events),
 f as (select *, 'd' || external_id % 9 document, external_id % 7 "row", case when p = 0 then 'exact' when p = 1 then 'unknown' end pr from c), firsts as (select source_id, document, "row", min(external_id) x from f group by 1, 2, 3),
 a as (select r.job, r.event_id, r.source_id in ('purchase', 'signup') direct, coalesce(i.first_at, d.first_at) first_at, coalesce(case when i.external_id is not null then i.pr else d.pr end, 'unknown') pr, case when i.external_id is not null then i.confirmed_at else d.confirmed_at end confirmed_at from refs r left join f i on i.source_id = r.source_id and i.external_id = r.external_id
   left join firsts x on x.source_id = r.source_id and x.document = r.document and x."row" = r."row" left join f d on d.source_id = x.source_id and d.external_id = x.x)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    user = c("user_id")
    refs = table(spark, sf_dir, "events").select((user % 50).alias("job"), "event_id", c("event_type").alias("source_id"), F.when(c("event_id") % 4 > 0, user).alias("external_id"), F.when(c("event_id") % 5 > 0, F.concat(F.lit("d"), user % 9)).alias("document"), (user % 7).alias("row"))
    x = c("external_id")
    seen = _sighted(spark, sf_dir).select("source_id", x, c("first_at").alias("first_observed_at"), F.when(c("p") == 0, "exact").when(c("p") == 1, "unknown").alias("precision"), "confirmed_at", F.concat(F.lit("d"), x % 9).alias("document"), (x % 7).alias("row"))
    return occurrences.attributed(refs, seen, spark.createDataFrame([("purchase",), ("signup",)], "source_id string"))


@query(f"{_ATTRIBUTED} select job, event_id, case when direct then 'direct-provider' else 'aggregator' end source_kind, first_at first_observed_at, pr as precision, confirmed_at from a")
def job_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of jobs with the sighting that each rests on, by id or by its place in a document."""
    return _attributed(spark, sf_dir).select("job", "event_id", "source_kind", "first_observed_at", "precision", "confirmed_at")


@query(f"{_ATTRIBUTED} select job, min(first_at) filter (direct and pr = 'exact') provider_first, min(first_at) filter (not direct and pr = 'exact') aggregator_first, provider_first - aggregator_first lag from a group by 1")
def attribution_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.attribution_lag(_attributed(spark, sf_dir))


_SEEDS = """with r as (select o_custkey job, o_orderkey "position", case o_orderkey % 3 when 0 then 'lever-' || o_orderstatus when 1 then 'shadow-greenhouse-' || o_orderstatus else 'github-' || o_orderstatus end source_id, case when o_orderkey % 5 = 0 then 'e' || o_orderkey % 40 when o_orderkey % 5 = 1 then '' end external_id,
   case when o_orderkey % 7 > 0 then 'd' || o_orderkey % 60 end document, case when o_orderkey % 11 > 0 then 'https://Jobs.Example.com/' || o_orderkey % 30 || '/?utm_source=x#y' else 'mailto:x' end url from orders),
 n as (select *, coalesce(nullif(external_id, ''), case when not starts_with(source_id, 'github-') then document when starts_with(url, 'https') then document || ':https://jobs.example.com/' || ("position" % 30) end) id from r),
 f as (select source_id, id, arg_min(job, (job, "position")) job, count(*) n, id in ('d7', 'd8', 'e5') there from n where id is not null group by 1, 2)"""


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_orderkey"), F.col
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    status = c("o_orderstatus")
    refs = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("job"), o.alias("position"), F.when(o % 3 == 0, text("lever-", status)).when(o % 3 == 1, text("shadow-greenhouse-", status)).otherwise(text("github-", status)).alias("source_id"),
        F.when(o % 5 == 0, text("e", o % 40)).when(o % 5 == 1, "").alias("external_id"), F.when(o % 7 > 0, text("d", o % 60)).alias("document"), F.when(o % 11 > 0, text("https://Jobs.Example.com/", o % 30, "/?utm_source=x#y")).otherwise("mailto:x").alias("apply_url"),
    )
    there = refs.select("source_id").distinct().withColumn("external_id", F.explode(F.array(*map(F.lit, ("d7", "d8", "e5")))))
    checkpoints = refs.where(c("source_id").startswith("lever-")).groupBy("source_id").agg(F.concat(F.lit("h"), F.count(F.lit(1))).alias("content_hash"))
    return occurrences.seed_occurrences(refs, there, checkpoints)


@query(f"""{_SEEDS}, h as (select source_id, 'h' || count(*) h from r where starts_with(source_id, 'lever-') group by 1)
 select f.source_id, id external_id, job, coalesce(h, 'backfill') changed_hash from f left join h on h.source_id = f.source_id where not there""")
def seeded_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as references of customers' jobs, seeded as sightings under the ids that their connectors would give."""
    return _seeded(spark, sf_dir)[0].select("source_id", "external_id", "job", "changed_hash")


@query(f"""{_SEEDS}, d as (select source_id, count_if(not there) seeded, sum(n - case when there then 0 else 1 end) skipped from f group by 1), l as (select source_id, count(*) lost from n where id is null group by 1)
 select coalesce(d.source_id, l.source_id) source_id, coalesce(seeded, 0)::bigint seeded, coalesce(skipped, 0)::bigint skipped, coalesce(lost, 0)::bigint unidentifiable from d full join l on l.source_id = d.source_id""")
def seeding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir)[1]
