"""Which reviewed board a posting's address belongs to, and what is proven of where it leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.url import host, scheme

#: Hosts of the boards, and a host whose postings have another public path.
GREENHOUSE_HOSTS, LEVER_HOST, ASHBY_HOST = ("job-boards.greenhouse.io", "boards.greenhouse.io"), "jobs.lever.co", "jobs.ashbyhq.com"
ALIAS_HOST = "lifeattiktok.com"
#: Names of boards.
SITE, BOARD = r"^[a-z0-9][a-z0-9-]{0,62}$", r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def path_of(url: Column) -> Column:
    """The path of an absolute address, ``/`` where there is none."""
    found = F.regexp_extract(F.trim(url), r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def canonical_application_url(url: Column) -> Column:
    """An address of the alias host's ``/position/<id>`` as its ``/search/<id>``; others as they are."""
    number = F.regexp_extract(path_of(url), r"^/position/(\d+)/?$", 1)
    return F.when((host(url) == ALIAS_HOST) & (number != ""), F.concat(F.lit(f"https://{ALIAS_HOST}/search/"), number)).otherwise(url)


def board_reference(url: Column) -> Column:
    """(provider, token, posting_id) of an address on a board, null for others."""
    name, path = F.regexp_replace(host(url), r"^www\.", ""), path_of(url)
    part = lambda pattern, n: F.regexp_extract(path, pattern, n)
    named = lambda provider, pattern: F.struct(F.lit(provider).alias("provider"), F.lower(part(pattern, 1)).alias("token"), part(pattern, 2).alias("posting_id"))
    jobs, site = r"^/([^/]+)/jobs/(\d+)", r"^/([^/]+)/([^/]+)"
    return F.when(name.isin(*GREENHOUSE_HOSTS) & path.rlike(jobs), named("greenhouse", jobs)).when((name == LEVER_HOST) & path.rlike(site), named("lever", site))


def lever_site(url: Column) -> Column:
    """The site that a Lever address names: a board's or a posting's path, in lower case."""
    found = F.lower(F.regexp_extract(path_of(url), r"^/([^/]+)(?:/[^/]+(?:/apply)?)?/?$", 1))
    return F.when((scheme(url) == "https") & (host(url) == LEVER_HOST) & found.rlike(SITE), found)


def ashby_board(url: Column) -> Column:
    """The board that an Ashby address names, its case kept: the first of one to three segments, the third being ``application``."""
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    name = F.try_url_decode(F.get(parts, F.lit(0)))
    fits = F.size(parts).between(1, 3) & ((F.size(parts) < 3) | (F.get(parts, F.lit(2)) == "application"))
    port = F.regexp_extract(F.trim(url), r"^(?i)https?://[^/?#]*:(\d+)", 1)
    return F.when((scheme(url) == "https") & (host(url) == ASHBY_HOST) & port.isin("", "443") & fits & name.rlike(BOARD) & ~name.isin(".", ".."), name)


def exact_ashby_url(url: Column, board: Column, posting: Column, application: bool) -> Column:
    wanted = F.concat(F.lit("/"), board, F.lit("/"), posting, F.lit("/application" if application else ""))
    authority = F.regexp_extract(F.trim(url), r"^(?i)https?://([^/?#]*)", 1)
    return (scheme(url) == "https") & F.lower(authority).isin(ASHBY_HOST, f"{ASHBY_HOST}:443") & (path_of(url) == wanted)


def lever_violation(posting: Column, hosted: Column, apply: Column, site: Column) -> Column:
    """What is wrong with a Lever posting's addresses, the first of all; null if nothing is."""
    found = None
    for name, url, end in (("hostedUrl", hosted, ""), ("applyUrl", apply, "/apply")):
        path = F.regexp_replace(path_of(url), "/$", "")
        wanted = F.concat(F.lit("/"), site, F.lit("/"), posting, F.lit(end))
        wrong = (
            F.when(url.isNull() | (host(url) == ""), f"{name} is not a URL").when((scheme(url) != "https") | (host(url) != LEVER_HOST), f"{name} is not on https://{LEVER_HOST}")
            .when(path != wanted, F.concat(F.lit(f"{name} does not match /"), site, F.lit("/"), posting))
        )
        found = wrong if found is None else F.coalesce(found, wrong)
    return found


def error_destination(url: Column) -> Column:
    """Whether both path and query say that nothing was found."""
    query = F.regexp_extract(F.trim(url), r"\?([^#]*)", 1)
    coded = F.exists(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).rlike("(?i)error|status|code") & F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, 10_000).rlike("(?i)404|not[-_]?found"))
    return path_of(url).rlike(r"(?i)(?:^|/)(?:404|not[-_]?found|error(?:page)?)(?:/|$)") & coded


def went_generic(source: Column, destination: Column) -> Column:
    """Whether a posting's address led to the front page of its host."""
    return (host(source) == host(destination)) & (path_of(source) != "/") & (path_of(destination) == "/")


def with_attribution(listings: DataFrame, url: str, source: str, registry: DataFrame, active: DataFrame) -> DataFrame:
    """``listings`` with basis and board_source.

    ``registry`` is (source_id, provider, token) of reviewed boards, ``active`` (source_id, external_id) of the
    postings that they show. ``provider-api``: the listing's own source is a reviewed board;
    ``reviewed-board``: its address names an active posting of one; else ``unattributed``. Boards are
    joined by name and postings by a semi-join on both, so no board's postings are gathered.
    """
    own = registry.select(F.col("source_id").alias("_own")).distinct()
    boards = registry.groupBy("provider", F.lower("token").alias("token")).agg(F.min("source_id").alias("_board"))
    shown = active.select(F.col("source_id").alias("_shown"), F.col("external_id").alias("_posting")).distinct()
    ref = listings.withColumn("_ref", board_reference(F.col(url)))
    named = ref.join(boards, (F.col("_ref.provider") == boards["provider"]) & (F.col("_ref.token") == boards["token"]), "left").drop("provider", "token")
    both = named.join(shown, (F.col("_board") == F.col("_shown")) & (F.col("_ref.posting_id") == F.col("_posting")), "left").join(own, F.col(source) == F.col("_own"), "left")
    basis = F.when(F.col("_own").isNotNull(), "provider-api").when(F.col("_shown").isNotNull(), "reviewed-board").otherwise("unattributed")
    return both.withColumn("basis", basis).withColumn("board_source", F.when(F.col("basis") == "provider-api", F.col("_own")).when(F.col("basis") == "reviewed-board", F.col("_shown"))).select(*listings.columns, "basis", "board_source")


def reachability(failed: Column, status: Column, signals: Column) -> Column:
    """Of a failed read by its status (null: none came), else of a read page by its signals."""
    return (
        F.when(failed & status.isin(404, 410), "gone").when(failed & status.isin(401, 403, 429), "blocked").when(failed, "unreachable")
        .when(F.array_contains(signals, "access restricted to scraper"), "blocked").when(F.array_contains(signals, "temporary server failure"), "unreachable").otherwise("live")
    )


def verified(basis: Column, reach: Column, described: Column) -> Column:
    """(alert_eligible, quarantine): something vouches for a role and nothing disproves it. ``described`` is null where no page was read."""
    gone = reach == "gone"
    return F.struct((~gone & ((basis != "unattributed") | F.coalesce(described, F.lit(True)))).alias("alert_eligible"), gone.alias("quarantine"))


def quarantine_gone(jobs: DataFrame, checks: DataFrame, url: str, key: str) -> DataFrame:
    """Open jobs without a validated address whose check says gone are closed, their address noted as invalid and
    their alerts dropped; other jobs stay as they are. ``checks`` is (url, reachability)."""
    gone = checks.where("reachability = 'gone'").select(F.col("url").alias("_gone")).distinct()
    joined = jobs.join(gone, F.col(url) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull() & F.col("open") & F.col("validated_at").isNull()
    return joined.withColumns({"open": F.col("open") & ~hit, "invalid_url": F.when(hit, F.col(url)).otherwise(F.col("invalid_url")), "pending": F.col("pending") & ~hit}).drop("_gone")
