"""Gates over whole registries of reviewed boards: what rows, ownership evidence, probes and policies must say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions.text import collapse, folded, identity_terms
from gleaner.functions.url import host, host_allowed, registrable_domain, scheme
from gleaner.operators.attribution import LEVER_HOST, SITE, path_of
from gleaner.operators.promotion import broken

#: States of ownership evidence, and the one that admits a board.
STATES = ("ownership-verified", "api-live-unattributed", "ambiguous-owner", "subsidiary-or-regional", "custom-host-review", "stale-or-reassigned", "inconclusive")
ADMISSIBLE = "ownership-verified"
#: Hosts that no employer controls; they and the hosts below them prove nothing.
FOREIGN_HOSTS = [
    "lever.co", "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "simplify.jobs", "builtin.com", "wellfound.com", "angel.co", "jobright.ai", "ycombinator.com",
    "workatastartup.com", "levels.fyi", "github.com", "githubusercontent.com", "web.archive.org", "google.com", "bing.com", "duckduckgo.com", "crunchbase.com", "glassdoor.co.uk",
]
#: Public suffixes of two labels.
TWO_LABELS = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.nz", "co.za", "co.jp", "co.kr", "co.in", "com.br", "com.mx", "com.sg", "com.cn", "com.tr", "com.hk",
]
#: Tokens of boards, endings that a lookup leaves out, and the host of boards whose tokens they are.
TOKEN = r"^[a-z0-9][a-z0-9_-]{0,62}$"
LOOKUP_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc")
TOKEN_HOST = "greenhouse.io"
#: Letters of an excerpt, and days after which evidence is verified again.
EXCERPT, REVERIFY_DAYS = 2000, 180

REGISTRY = "source_id string, position long, board string, company string, careers_url string, admitted_at long, region string, status string, evidence_status string"
EVIDENCE = "folder string, malformed boolean, board string, company string, careers_url string, page_url string, excerpt string, job_url string, hosts array<string>, region string, state string, verified_at long, notes string"
PROBE = "folder string, malformed boolean, board string, state string, attribution string, region string, url_violations long, malformed_rows long, hosts array<string>, n_results long, probed_at long"
EVIDENCE_COLUMNS = [x.split()[0] for x in EVIDENCE.split(", ")]
POLICY = "source_id string, source_class string, board string"


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of evidence folders (``<folder>/<name>.json``) with ``folder`` and ``malformed``.

    A document that is no JSON object of the schema is a row whose other columns are null, so gates can name it.
    """
    docs = spark.read.schema(schema + ", _malformed string").option("multiLine", True).option("columnNameOfCorruptRecord", "_malformed").json(path)
    return docs.withColumns({"folder": F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1), "malformed": F.col("_malformed").isNotNull()}).drop("_malformed")


def quoted(text: Column) -> Column:
    """A text as a pattern that matches just this text."""
    return F.regexp_replace(text, "([^A-Za-z0-9])", r"\\$1")


def names_board(text: Column, board: Column, name: str = LEVER_HOST) -> Column:
    """Whether a text holds a board's address and not that of a board whose name only begins so."""
    pattern = F.concat(F.lit("(?i)" + name.replace(".", r"\.") + "/"), quoted(board), F.lit("(?![a-z0-9-])"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def _https_host(url: Column) -> Column:
    return F.when((scheme(url) == "https") & (host(url) != ""), host(url))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def evidence_rules(c=F.col, careers: Column | None = None, page: Column | None = None, job_host: Column | None = None) -> dict[str, Column]:
    """What a row of ``EVIDENCE`` breaks by itself; ``c`` gives its columns by name. The hosts of its three addresses can be given as columns."""
    careers, page, job_host = (_https_host(c(name)) if h is None else h for name, h in (("careers_url", careers), ("page_url", page), ("job_url", job_host)))
    told = ~_blank(c("excerpt"))
    posting = F.regexp_like(path_of(c("job_url")), F.concat(F.lit("^/"), quoted(F.coalesce(c("board"), F.lit(""))), F.lit("/[^/]+(?:/apply)?/?$")))
    hosts = F.coalesce(c("hosts"), F.array().cast("array<string>"))
    outside = F.exists(hosts, lambda h: F.lower(h) != LEVER_HOST)
    return {
        "board-invalid": ~F.coalesce(c("board").rlike(SITE), F.lit(False)),
        "state-unknown": ~F.coalesce(c("state").isin(*STATES), F.lit(False)),
        "no-company": _blank(c("company")),
        "region-unsupported": ~F.coalesce(c("region") == "global", F.lit(False)),
        "verified-time-invalid": c("verified_at").isNull(),
        "careers-not-https": careers.isNull(), "careers-foreign": host_allowed(careers, FOREIGN_HOSTS),
        "page-not-https": page.isNull(), "page-foreign": host_allowed(page, FOREIGN_HOSTS),
        "page-of-other-domain": registrable_domain(careers, TWO_LABELS) != registrable_domain(page, TWO_LABELS),
        "no-excerpt": ~told & (c("state") == ADMISSIBLE), "neither-excerpt-nor-notes": ~told & ~F.coalesce(c("state") == ADMISSIBLE, F.lit(False)) & _blank(c("notes")),
        "excerpt-too-long": told & (F.length(c("excerpt")) > EXCERPT), "excerpt-without-board": told & (F.length(c("excerpt")) <= EXCERPT) & ~names_board(c("excerpt"), c("board")),
        "job-not-https": job_host.isNull(), "job-on-other-host": job_host != LEVER_HOST, "job-not-on-board": (job_host == LEVER_HOST) & ~posting,
        "no-hosts": F.size(hosts) == 0, "hosts-outside": outside & ~F.coalesce(c("state") == "custom-host-review", F.lit(False)),
    }


def with_broken(rows: DataFrame, c=F.col) -> DataFrame:
    """``rows`` with ``_rules``: what the evidence whose columns ``c`` names breaks, ``evidence-malformed`` alone if it cannot be read.

    The hosts are columns of their own, so that an address is taken apart once and not in each rule.
    """
    hosts = {"_careers": _https_host(c("careers_url")), "_page": _https_host(c("page_url")), "_job": _https_host(c("job_url"))}
    rules = broken(evidence_rules(c, *map(F.col, hosts)))
    return rows.withColumns(hosts).withColumn("_rules", F.when(F.coalesce(c("malformed"), F.lit(False)), F.array(F.lit("evidence-malformed"))).otherwise(rules)).drop(*hosts)


def _probe_rules(board: Column, clean: Column) -> tuple[Column, dict[str, Column], dict[str, Column]]:
    """Whether a probe can be read, what it breaks, and what it breaks besides if it must be clean and is ok."""
    c = F.col
    unlike = lambda name, v: ~F.coalesce(c(name) == v, F.lit(False))
    unread = F.when(c("probe.malformed"), "probe-malformed").when(c("probe.probed_at").isNull(), "probe-time-invalid").when(unlike("probe.attribution", "unattributed"), "probe-attributed").when(unlike("probe.n_results", 1), "probe-not-one-result")
    first = {"probe-of-other-board": ~F.coalesce(c("probe.board") == board, F.lit(False)), "probe-not-ok": clean & unlike("probe.state", "ok")}
    rest = {
        "probe-region": unlike("probe.region", "global"), "probe-url-violations": unlike("probe.url_violations", 0), "probe-malformed-rows": unlike("probe.malformed_rows", 0),
        "probe-without-hosts": c("probe.hosts").isNull(), "probe-hosts-outside": F.exists("probe.hosts", lambda h: h != LEVER_HOST),
    }
    return unread, first, rest


def _probe_violations(board: Column, clean: Column) -> Column:
    unread, first, rest = _probe_rules(board, clean)
    none = F.array().cast("array<string>")
    whole = F.concat(broken(first), F.when(clean & (F.col("probe.state") == "ok"), broken(rest)).otherwise(none))
    return F.when(F.col("probe").isNull(), F.array(F.lit("no-probe"))).when(unread.isNotNull(), F.array(unread)).otherwise(whole)


def manifest_violations(registry: DataFrame, evidence: DataFrame, probes: DataFrame, policies: DataFrame, now: int, namespace: str = "lever") -> DataFrame:
    """(subject, violations) of every registry row, every policy of a class without one, and every folder that no row claims.

    All joins are on whole keys. Of rows with one id, or one board, the first by position is the one that counts and later ones
    are told; ``evidence_status`` ``legacy-review`` needs no evidence. A folder that waits for admission must be well-formed too.
    """
    c, none = F.col, F.array().cast("array<string>")
    # Rules are told where a folder's row has met its board, so by the tasks of the join and once for a folder.
    seen = evidence.groupBy("folder").agg(F.min(F.struct(*EVIDENCE_COLUMNS[1:])).alias("evidence")).withColumnRenamed("folder", "_folder")
    probed = probes.groupBy("folder").agg(F.min(F.struct(*(x for x in probes.columns if x != "folder"))).alias("probe")).withColumnRenamed("folder", "_probed")
    both = seen.join(probed, c("_folder") == c("_probed"), "left").withColumn("_bad", F.coalesce("evidence.malformed", F.lit(False)))
    told = lambda df: with_broken(df, lambda name: c(f"evidence.{name}"))

    ids = registry.groupBy("source_id").agg(F.min("position").alias("_first"))
    boards = registry.groupBy("board").agg(F.min("position").alias("_first_board"))
    policy = policies.groupBy("source_id").agg(F.min(F.struct("source_class", "board")).alias("policy"))
    rows = told(registry.join(ids, "source_id").join(boards, "board", "left").join(policy, "source_id", "left").join(both, c("board") == c("_folder"), "left"))
    age = F.floor((F.lit(now) - c("admitted_at")) / 86400)
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    head = {
        "duplicate-id": c("position") > c("_first"), "duplicate-board": c("position") > c("_first_board"), "id-not-namespaced": ~c("source_id").startswith(f"{namespace}-"),
        "no-policy": c("policy").isNull(), "policy-class": c("policy").isNotNull() & ~F.coalesce(c("policy.source_class") == namespace, F.lit(False)),
        "policy-board": (c("policy.source_class") == namespace) & differs("policy.board", "board"),
        "admission-time-invalid": c("admitted_at").isNull(), "verification-overdue": age > REVERIFY_DAYS,
    }
    agree = {
        "not-admissible": ~F.coalesce(c("evidence.state") == ADMISSIBLE, F.lit(False)), "other-board": differs("evidence.board", "board"), "other-company": differs("evidence.company", "company"),
        "other-careers": differs("evidence.careers_url", "careers_url"), "other-region": differs("evidence.region", "region"), "other-time": ~F.coalesce(c("evidence.verified_at") == c("admitted_at"), F.lit(False)),
    }
    no_probe = F.when(c("probe").isNull(), F.array(F.lit("no-probe"))).otherwise(none)
    proof = (
        F.when(F.coalesce(c("evidence_status") == "legacy-review", F.lit(False)), none).when(c("evidence").isNull(), F.array(F.lit("no-evidence"))).when(c("_bad"), F.concat(no_probe, c("_rules")))
        .otherwise(F.concat(no_probe, c("_rules"), broken(agree), F.when(c("probe").isNull(), none).otherwise(_probe_violations(c("board"), F.lit(True)))))
    )
    of_rows = rows.select(c("source_id").alias("subject"), F.concat(broken(head), proof).alias("violations"))

    of_policies = policies.where(c("source_class") == namespace).join(registry, "source_id", "left_anti").select(c("source_id").alias("subject"), F.array(F.lit("policy-without-source")).alias("violations"))
    claimed = registry.select(c("board").alias("_board")).distinct()
    free = told(both.join(claimed, c("_folder") == c("_board"), "left_anti"))
    clean = F.coalesce(c("evidence.state") == ADMISSIBLE, F.lit(False))
    waiting = F.when(c("_bad"), c("_rules")).otherwise(F.concat(broken({"other-folder": ~c("evidence.board").eqNullSafe(c("_folder"))}), c("_rules"), _probe_violations(c("_folder"), clean)))
    bare = probed.join(seen, c("_probed") == c("_folder"), "left_anti").join(claimed, c("_probed") == c("_board"), "left_anti")
    return (
        of_rows.unionByName(of_policies).unionByName(free.select(c("_folder").alias("subject"), waiting.alias("violations")))
        .unionByName(bare.select(c("_probed").alias("subject"), F.array(F.lit("folder-without-evidence")).alias("violations")))
    )


def manifest_summary(registry: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: reviewed, published and shadow rows, verified and legacy ones, and how many admissible folders wait for a row."""
    c = F.col
    counts = registry.agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(c("status") == "published").alias("published"), F.count_if(c("status") == "shadow").alias("shadow"),
        F.count_if(c("evidence_status") == "agent-verified").alias("agent_verified"), F.count_if(c("evidence_status") == "legacy-review").alias("legacy_review"),
    )
    return counts.join(pending_admission(registry, evidence).agg(F.count(F.lit(1)).alias("pending")), F.lit(True))


def pending_admission(registry: DataFrame, evidence: DataFrame) -> DataFrame:
    """Folders with evidence that admits a board and no registry row: the rows that they would become, as shadow."""
    good = evidence.where(~F.coalesce("malformed", F.lit(False)) & (F.col("state") == ADMISSIBLE))
    free = good.join(registry.select(F.col("board").alias("_b")).distinct(), F.col("folder") == F.col("_b"), "left_anti").repartition("folder")
    # A filter on the rules would be moved to where rows are read, with every column written out in each rule; a generator stays here.
    found = with_broken(free).select("*", F.explode(F.when(F.size("_rules") == 0, F.array(F.lit(True)))).alias("_whole"))
    return found.select(F.concat(F.lit("lever-"), "board").alias("source_id"), "board", "company", "careers_url", F.col("verified_at").alias("admitted_at"), "region", F.lit("shadow").alias("status"), F.lit("agent-verified").alias("evidence_status"))


def recheck(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(folder, state, fidelity, still_proven) of evidence against its page as it is now.

    ``pages`` is (page_url, status, html), status null where none came. State: ``malformed-record`` for evidence that breaks a
    rule, ``transport-error``, ``http-error``, else ``ok`` with ``exact`` (the page still holds the excerpt, white space
    aside), ``link-only`` (it names the board but in other words) or ``missing``.
    """
    c = F.col
    told = with_broken(evidence).select("folder", "board", "page_url", "excerpt", F.size("_rules").alias("_n"))
    now = pages.groupBy("page_url").agg(F.min_by(F.struct("status", "html"), F.struct("status", F.xxhash64("html"))).alias("_page"))
    both = told.join(now, "page_url", "left")
    page = collapse(F.coalesce("_page.html", F.lit("")))
    state = F.when(c("_n") > 0, "malformed-record").when(c("_page.status").isNull(), "transport-error").when(~c("_page.status").between(200, 299), "http-error").otherwise("ok")
    fidelity = F.when(~names_board(page, c("board")), "missing").when(F.contains(page, collapse(F.coalesce("excerpt", F.lit("")))), "exact").otherwise("link-only")
    out = both.withColumn("state", state).withColumn("fidelity", F.when(c("state") == "ok", fidelity))
    return out.select("folder", "state", "fidelity", (c("fidelity") != "missing").alias("still_proven"))


def board_name(name: Column, fold=folded) -> Column:
    """A board's name folded, its endings kept."""
    return identity_terms(name, fold)


def lookup_key(name: Column, fold=folded) -> Column:
    """A name as one looks it up: folded words without company endings, one word at least."""
    return F.regexp_replace(identity_terms(name, fold), f"(?<=.)( ({'|'.join(LOOKUP_SUFFIXES)}))+$", "")


def config_error(fold=folded) -> Column:
    """The first rule that a row of a registry of tokens breaks; null if none.

    Columns: source_id, token, employer_id, display_name, aliases, careers_url, expected_names, admitted_name, admitted_at (ISO text),
    initial_hosts, final_hosts, host_reason, status, evidence_status. ``expected_names`` and ``admitted_name`` are compared folded.
    """
    c, none = F.col, F.array().cast("array<string>")
    empty = lambda name: F.coalesce(F.size(name), F.lit(0)) <= 0
    hosts = F.concat(F.coalesce("initial_hosts", none), F.coalesce("final_hosts", none))
    named = F.array_join(F.transform(F.coalesce("expected_names", none), lambda n: F.regexp_replace(n, "\n", " ")), "\n")
    # Folding is a function of whole columns, so expected names fold as lines of one text.
    folded_names = F.transform(F.split(fold(named), "\n"), lambda n: F.trim(F.regexp_replace(n, "[^a-z0-9]+", " ")))
    admitted = board_name(c("admitted_name"), fold)
    rules = {
        "token-invalid": ~F.coalesce(c("token").rlike(TOKEN), F.lit(False)), "id-not-of-token": ~c("source_id").eqNullSafe(F.concat(F.lit("greenhouse-"), "token")), "no-employer": _blank(c("employer_id")), "no-name": _blank(c("display_name")), "no-aliases": empty("aliases"),
        "careers-invalid": F.coalesce(host(c("careers_url")) == "", F.lit(True)), "careers-not-https": scheme(c("careers_url")) != "https",
        "expected-names": empty("expected_names") | F.exists(F.coalesce("expected_names", none), lambda n: F.trim(n) == ""), "admitted-name": (admitted == "") | ~F.array_contains(folded_names, admitted),
        "admission-time": ~F.coalesce(c("admitted_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"), F.lit(False)) | F.try_to_timestamp("admitted_at").isNull(), "no-initial-hosts": empty("initial_hosts"), "no-final-hosts": empty("final_hosts"),
        "host-not-bare": F.exists(hosts, lambda h: ~h.rlike("^[A-Za-z0-9._-]+$")), "host-without-reason": F.exists(hosts, lambda h: ~host_allowed(F.lower(h), [TOKEN_HOST])) & _blank(c("host_reason")),
        "status": ~F.coalesce(c("status").isin("shadow", "published"), F.lit(False)), "evidence-status": ~F.coalesce(c("evidence_status").isin("reviewed", "api-probed"), F.lit(True)),
    }
    return F.coalesce(*(F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in rules.items()))


def registry_errors(registry: DataFrame, fold=folded) -> DataFrame:
    """(source_id, token, error) of rows that break a rule or repeat an id or a token; pass it to :func:`gleaner.operators.ledger.require_none`."""
    ids = registry.groupBy("source_id").agg(F.count(F.lit(1)).alias("_ids"))
    tokens = registry.groupBy("token").agg(F.count(F.lit(1)).alias("_tokens"))
    told = registry.withColumn("error", config_error(fold)).join(ids, "source_id", "left").join(tokens, "token", "left")
    error = F.coalesce("error", F.when(F.col("_ids") > 1, "duplicate-id"), F.when(F.col("_tokens") > 1, "duplicate-token"))
    return told.withColumn("error", error).where("error is not null").select("source_id", "token", "error")


def find_reviewed(queries: DataFrame, registry: DataFrame, fold=folded) -> DataFrame:
    """(query, status, source_id, n_candidates): a source by its id, else by its name, employer or alias under :func:`lookup_key`.

    ``queries`` has a column ``query``; status is found, unknown or ambiguous, source_id null unless found. Names that are one
    after folding meet in an equi-join on distinct (key, source), and only counts leave it.
    """
    c = F.col
    asked = queries.select("query").distinct().withColumn("_id", F.trim(F.coalesce("query", F.lit("")))).withColumn("_key", lookup_key(c("query"), fold))
    by_id = registry.select(c("source_id").alias("_own")).distinct()
    names = registry.select(c("source_id").alias("_source"), F.explode(F.concat(F.array("display_name", "employer_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
    keys = names.select("_source", lookup_key(c("_name"), fold).alias("_k")).where("_k <> ''").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_source").alias("_source"))
    both = asked.join(by_id, c("_id") == c("_own"), "left").join(keys, c("_key") == c("_k"), "left")
    n = F.when(c("_own").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0)))
    out = both.withColumn("n_candidates", n.cast("long")).withColumn("status", F.when(c("n_candidates") == 0, "unknown").when(c("n_candidates") == 1, "found").otherwise("ambiguous"))
    return out.select("query", "status", F.when(c("status") == "found", F.coalesce("_own", "_source")).alias("source_id"), "n_candidates")
