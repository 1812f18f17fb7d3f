"""Postings to listings, repaired titles, same roles, merges and attribution, with expected values written out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.operators import attribution, classify, identity, processing

WORDS = classify.Dictionary(lifecycle="interns?|internship|new grad", strong="software|compilers?", stack="python|sql", business="marketing", categories={"design": "design"})
KNOWN = ["Software Engineer Intern", "Quantitative Research Intern", "Research Intern"]
POSTING = "external_id string, company string, title string, content array<struct<format:string,value:string>>, locations array<string>, season_hint string, season_authority string, apply_url string, state string, authority string, tags array<string>, declared_mode string, citizenship boolean, degree boolean, pay_text string"


def posting(external_id, title, content="", company="Acme", url="https://x.com/1", locations=(), **more):
    values = dict(external_id=external_id, company=company, title=title, content=[("html", content)], locations=list(locations), apply_url=url, state="open", authority="title") | more
    return tuple(values.get(c.split()[0]) for c in POSTING.split(", "))


def processed(spark, *rows):
    df = spark.createDataFrame(list(rows), POSTING).withColumn("source_id", F.lit("s"))
    return {r["external_id"]: r for r in processing.process_postings(df, WORDS, KNOWN, ["agg.com"], dt.date(2026, 8, 1)).collect()}


def test_the_whole_projection(spark):
    got = processed(
        spark,
        posting("a", "Software &amp; Systems Intern, Summer 2027", "<p>Must be a U.S. citizen. $40 - $50/hour, remote.</p>", locations=["<b>NYC</b>", "", "SF"], season_hint="fall-2026"),
        posting("b", "Intern", "software python sql compilers. Ph.D. required. Founded 2010, start 2028.", declared_mode="Hybrid", citizenship=False, season_hint=None),
        posting("c", "Marketing Intern", "python", season_hint="fall-2026", season_authority="source-default", pay_text="$104,000 per year"),
        posting("d", "Software Intern", url="http://x.com"),
        posting("e", "Software Intern", url="https://agg.com/1"),
        posting("f", "Manager", "x"),
        posting("g", "Manager", "x", authority="source", tags=["Software"]),
        posting("h", "Software Intern", state="prospect"),
        posting("i", None, None),
    )
    a = got["a"]
    assert (a["title"], a["location"], a["season"], a["work_mode"], a["max_hourly"], a["citizenship"], a["degree"], a["outcome"], a["title_repaired"]) == ("Software & Systems Intern, Summer 2027", "NYC / SF", "summer-2027", "remote", 50.0, True, False, "included", False)
    b = got["b"]
    assert (b["season"], b["work_mode"], b["citizenship"], b["degree"], b["basis"], b["technical"], b["location"]) == ("2028", "hybrid", False, True, "description", True, "Unspecified")
    assert (got["c"]["outcome"], got["c"]["season"], got["c"]["season_source"], got["c"]["max_hourly"]) == ("shelved", "fall-2026", "source-default", 50.0)
    assert [got[k]["reason"] for k in "defghi"] == ["invalid-application-url", "aggregator-destination", "not-early-career", "source-policy", "prospect", "not-early-career"]


def test_cut_titles(spark):
    rows = [("Acme", "Software Engineer Intern (Compilers)"), ("ACME", "Software Engineer Intern (Compi..."), ("Acme", "Soft…"), ("Beta", "Quantitative Research Intern - Equiti..."), ("Beta", "Data Intern (Rec..."), ("Beta", "Odd..."), ("Beta", "..."), (None, None), ("Beta", " Whole ")]
    got = [r["repaired"] for r in processing.repair_titles(spark.createDataFrame(rows, "company string, title string").withColumn("n", F.monotonically_increasing_id()), "company", "title", KNOWN).orderBy("n").collect()]
    assert got == ["Software Engineer Intern (Compilers)"] * 3 + ["Quantitative Research Intern", "Data Intern", "Odd", "...", "", "Whole"]


ROLE = "k int, company string, season string, title string, repaired boolean"


@pytest.mark.parametrize(
    "left, right, want",
    [(("Acme", "Software Engineer Intern"), ("ACME", "Software Engineer Intern (Backend)"), True), (("Acme", "Software Engineer Intern"), ("Beta", "Software Engineer Intern"), False), (("Acme", "Data Engineer Intern"), ("Acme", "Hardware Engineer Intern"), False), (("Acme", "Softw"), ("Acme", "Software Engineer"), True), (("Acme", "a b c d e"), ("Acme", "x b c d e y z"), True), (("Acme", "--"), ("Acme", "x"), False)],
)
def test_one_role(spark, left, right, want):
    for first, second in ((left, right), (right, left)):
        df = spark.createDataFrame([(1, first[0], "s", first[1], False), (2, second[0], "s", second[1], True)], ROLE)
        assert identity.role_links(df, "k", "company", "season", "title", "repaired").count() == want


def test_roles_ask_for_a_repaired_later_title_and_chain(spark):
    rows = [(1, "A", "s", "Software Engineer Intern", False), (2, "A", "s", "Software Engineer Intern Backend", False), (3, "A", "s", "Software Engineer Intern Backend Team", True), (4, "A", "t", "Software Engineer Intern", True), (5, "A", "s", "Sales", True)]
    df = spark.createDataFrame(rows, ROLE)
    links = identity.role_links(df, "k", "company", "season", "title", "repaired")
    assert sorted(map(tuple, links.collect())) == [(3, 1)]
    keyed = df.withColumn("url", F.when(F.col("k").isin(3, 5), "same")).withColumn("fp", F.when(F.col("k") == 2, "x"))
    assert sorted(map(tuple, identity.same_items(keyed, "k", ["url", "fp"], links).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 1)]
    assert identity.same_items(keyed.limit(0), "k", ["url", "fp"]).count() == 0


def test_merges_keep_and_replace_by_field(spark):
    stored = spark.createDataFrame([("j", "Acme", "", "Unknown", "old", "https://a/1", "a/1", None, None, 30.0, None), ("q", "Q", "T", "X", "s", "u", "bad", None, "bad", None, None)], "job string, company string, title string, location string, season string, apply_url string, url string, validated_at string, invalid_url string, hourly double, requirements string")
    listing = "job string, company string, title string, location string, season string, apply_url string, url string, validated_at string, hourly double, requirements string, order long, source_id string, external_id string, state string, technical boolean"
    rows = [("j", "Other", "SWE Intern", "TBD", "s1", "https://a/2", "a/2", None, 0.0, "r", 1, "x", "1", "open", None), ("j", "Other", "Later", "NYC", "s2", "https://a/3", "a/3", "now", 40.0, None, 2, "y", "2", "open", False), ("j", "Z", "Z", "SF", "s3", "https://a/4", "a/4", None, 0.0, None, 3, "x", "1", "closed", True), ("q", "Q", "T", "X", "s", "u", "bad", None, 0.0, None, 1, "x", "9", "open", True)]
    got = {r["job"]: r for r in identity.merge_listings(stored, spark.createDataFrame(rows, listing), "now").collect()}
    j = got["j"]
    assert (j["company"], j["title"], j["location"], j["season"], j["apply_url"], j["hourly"], j["requirements"], j["open"], j["technical"]) == ("Acme", "SWE Intern", "NYC", "s3", "https://a/3", 40.0, "r", True, False)
    assert j["references"] == ["x|1|closed", "y|2|open"] and (got["q"]["open"], got["q"]["invalid_url"]) == (False, "bad")
    closed = spark.range(1).select(identity.close_reference(F.array(F.lit("x|1|open"), F.lit("y|2|open")), F.lit("x"), F.lit("1"))).first()[0]
    assert closed == ["x|1|closed", "y|2|open"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_addresses(spark):
    ref = lambda u: (lambda r: r and tuple(r))(one(spark, attribution.board_reference(F.lit(u))))
    assert ref("https://job-boards.greenhouse.io/stripe/jobs/8657500002") == ("greenhouse", "stripe", "8657500002")
    assert ref("https://jobs.lever.co/palantir/9e40d77f/apply") == ("lever", "palantir", "9e40d77f")
    assert ref("https://www.tesla.com/careers/search/job/12345") is None and ref("not a url") is None
    assert one(spark, attribution.canonical_application_url(F.lit("https://lifeattiktok.com/position/123/"))) == "https://lifeattiktok.com/search/123"
    assert one(spark, attribution.canonical_application_url(F.lit("https://x.com/position/123"))) == "https://x.com/position/123"
    sites = [one(spark, attribution.lever_site(F.lit(u))) for u in ("https://jobs.lever.co/Acme", "https://jobs.lever.co/acme/1/apply", "http://jobs.lever.co/acme", "https://jobs.lever.co/a.b", "https://jobs.lever.co/acme/1/x")]
    assert sites == ["acme", "acme", None, None, None]
    boards = [one(spark, attribution.ashby_board(F.lit(u))) for u in ("https://jobs.ashbyhq.com/Acme%20x", "https://jobs.ashbyhq.com/Acme/1/application", "https://jobs.ashbyhq.com/Acme/1/other", "https://jobs.ashbyhq.com:443/A", "https://jobs.ashbyhq.com:80/A", "https://jobs.ashbyhq.com/")]
    assert boards == [None, "Acme", None, "A", None, None]
    assert one(spark, attribution.lever_violation(F.lit("1"), F.lit("https://jobs.lever.co/acme/1/"), F.lit("https://jobs.lever.co/acme/1/apply"), F.lit("acme"))) is None
    assert one(spark, attribution.lever_violation(F.lit("1"), F.lit("https://jobs.lever.co/acme/2"), F.lit("x"), F.lit("acme"))) == "hostedUrl does not match /acme/1"
    assert one(spark, attribution.exact_ashby_url(F.lit("https://jobs.ashbyhq.com/A/1/application"), F.lit("A"), F.lit("1"), True)) and not one(spark, attribution.exact_ashby_url(F.lit("https://u@jobs.ashbyhq.com/A/1"), F.lit("A"), F.lit("1"), False))
    assert one(spark, attribution.error_destination(F.lit("https://x.com/not-found?errorCode=404"))) and not one(spark, attribution.error_destination(F.lit("https://x.com/404")))
    assert one(spark, attribution.went_generic(F.lit("https://x.com/jobs/1"), F.lit("https://x.com/"))) and not one(spark, attribution.went_generic(F.lit("https://x.com/"), F.lit("https://x.com/")))


def test_what_alerts(spark):
    reach = lambda failed, status, *signals: one(spark, attribution.reachability(F.lit(failed), F.lit(status).cast("int"), F.array(*map(F.lit, signals)).cast("array<string>")))
    assert [reach(True, s) for s in (410, 404, 403, 503, None)] == ["gone", "gone", "blocked", "unreachable", "unreachable"]
    assert [reach(False, 200, "access restricted to scraper"), reach(False, 200, "temporary server failure"), reach(False, 200, "destination reached")] == ["blocked", "unreachable", "live"]
    verdict = lambda basis, r, described: tuple(one(spark, attribution.verified(F.lit(basis), F.lit(r), F.lit(described).cast("boolean"))))
    assert [verdict("provider-api", "implied", None), verdict("reviewed-board", "live", False), verdict("unattributed", "live", True), verdict("unattributed", "blocked", False), verdict("unattributed", "implied", None), verdict("provider-api", "gone", True), verdict("unattributed", "unreachable", None)] == [(True, False), (True, False), (True, False), (False, False), (True, False), (False, True), (True, False)]


def test_gone_jobs_are_quarantined(spark):
    jobs = spark.createDataFrame([(1, "u1", True, None, None, True), (2, "u2", True, None, None, True), (3, "u1", True, "day", None, True), (4, "u1", False, None, None, False)], "job int, url string, open boolean, validated_at string, invalid_url string, pending boolean")
    checks = spark.createDataFrame([("u1", "gone"), ("u1", "gone"), ("u2", "unreachable")], "url string, reachability string")
    got = sorted((r["job"], r["open"], r["invalid_url"], r["pending"]) for r in attribution.quarantine_gone(jobs, checks, "url", "job").collect())
    assert got == [(1, False, "u1", False), (2, True, None, True), (3, True, None, True), (4, False, None, False)]


def test_identity_joins_send_no_table_through_the_driver(spark):
    df = spark.createDataFrame([(k, "a", "s", f"red bolt {k % 3}", k % 2 == 0, f"u{k % 2}") for k in range(6)], "k long, company string, season string, title string, repaired boolean, url string")
    links = identity.role_links(df, "k", "company", "season", "title", "repaired")
    for out in (links, identity.same_items(df, "k", ["url"], links)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
