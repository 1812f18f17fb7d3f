import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.functions import season, text, url
from gleaner.operators import classify, filters, identity, reconcile

NOW = dt.date(2026, 8, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("HTTPS://Jobs.Example.com/a/?utm_x=1&b=2&a=1#top", "https://jobs.example.com/a/?a=1&b=2"), ("https://example.com/", "https://example.com"), ("https://example.com?ref=z", "https://example.com"), ("not a url", None), (None, None)])
def test_normalize_url(spark, raw, want):
    assert one(spark, url.normalize_url(F.lit(raw).cast("string"))) == want


def test_url_rules(spark):
    reject = lambda x: one(spark, url.url_rejection(F.lit(x), ["agg.example.com"]))
    assert [reject(x) for x in ("ftp", "http://a.com/x", "https://agg.example.com/1", "https://a.com")] == ["invalid", "not-https", "aggregator", None]
    assert one(spark, url.host_allowed(F.lit("a.b.com"), ["b.com"])) and not one(spark, url.host_allowed(F.lit("ab.com"), ["b.com"]))
    assert one(spark, url.registrable_domain(F.lit("x.y.co.uk"), ["co.uk"])) == "y.co.uk"
    assert one(spark, url.last_number(F.lit("https://a.com/jobs/1234567?x=1"))) == "1234567"


@pytest.mark.parametrize("raw, want", [("Intern, Summer 2027", "summer-2027"), ("founded 2010, start 2027", "2027"), ("founded 2010", "ongoing"), ("", "ongoing")])
def test_season(spark, raw, want):
    assert one(spark, season.infer_season(F.lit(raw), NOW)) == want


@pytest.mark.parametrize("raw, want", [("summer-2026", True), ("fall-2026", False), ("fall-2025", True), ("offseason-2026", False), ("2025", True), ("ongoing", False)])
def test_past_season(spark, raw, want):
    assert one(spark, season.is_past_season(F.lit(raw), NOW)) is want


@pytest.mark.parametrize("raw, want", [("Pays $40 - $50/hour", 50.0), ("$104,000 per year", 50.0), ("30-35 per hr", 35.0), ("no pay", None)])
def test_pay(spark, raw, want):
    assert one(spark, season.max_hourly_pay(F.lit(raw))) == want


def test_text(spark):
    assert one(spark, text.html_to_text(F.lit("<p>Pays $50 &amp; a&nbsp;U.S.&lt;b&gt; citizen.</p>"))) == "Pays $50 & a U.S. citizen."
    assert one(spark, text.markdown_to_text(F.lit("![x](y) [**Acme**](http://a) role"))) == "Acme role"
    company = [one(spark, text.canonical_company(F.lit(x))) for x in ("Acme, Inc.", "Acme Incorporated", "ACME INC", "Acme Capital", "Inc", "Société ﬁn")]
    assert company == ["acme", "acme", "acme", "acme capital", "inc", "societe fin"]
    titles = {one(spark, text.canonical_title(F.lit(x))) for x in ("Software Engineering Internship", "Software Engineer Intern", "SWE Intern")}
    assert titles == {"engineer intern software"}
    assert {one(spark, text.canonical_location(F.lit(x))) for x in ("New York, NY", "NYC", "New York City")} == {"new york ny"}


WORDS = classify.Dictionary(lifecycle="intern", strong="software", stack="python|sql", business="marketing", categories={"design": "design"})


def test_decisions_in_order(spark):
    rows = [("a", "prospect", "Intern", "", "https://x.com", "title"), ("b", "open", "Manager", "", "https://x.com", "title"), ("c", "open", "Software intern", "", "nope", "title"), ("d", "open", "Software intern", "", "https://agg.com/1", "title"), ("e", "open", "Marketing intern", "python", "https://x.com", "title"), ("f", "open", "Intern", "software software python SQL", "https://x.com", "title"), ("g", "open", "Analyst", "", "https://x.com", "source"), ("h", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "external_id string, state string, title string, content string, apply_url string, authority string").withColumn("source_id", F.lit("s"))
    decisions = classify.decide(df, WORDS, ["agg.com"])
    got = {r["external_id"]: (r["outcome"], r["reason"]) for r in decisions.collect()}
    assert got == {"a": ("filtered", "prospect"), "b": ("filtered", "not-early-career"), "c": ("withheld", "invalid-application-url"), "d": ("withheld", "aggregator-destination"), "e": ("shelved", "nontechnical"), "f": ("included", "source-policy"), "g": ("shelved", "nontechnical"), "h": ("filtered", "not-early-career")}
    assert classify.decision_counts(decisions).first()["valid"] == 8


def test_filter(spark):
    schema = "title string, categories array<string>, employer string, filter struct<include_keywords:array<string>,include_categories:array<string>,include_employers:array<string>,exclude_keywords:array<string>,exclude_categories:array<string>,exclude_employers:array<string>,exclude_citizenship:boolean,exclude_degree:boolean>"
    f = (["robotics"], ["ai-ml"], None, ["senior"], None, None, None, None)
    rows = [("Machine Learning Intern", ["ai-ml"], "normal", f), ("Robotics Intern", [], "normal", f), ("Senior Machine Learning Intern", ["ai-ml"], "normal", f), ("Finance Intern", [], "normal", f), ("Any", [], "normal", (None,) * 8), ("Any", [], "normal", (None, None, ["startup"], None, None, None, None, None))]
    got = spark.createDataFrame(rows, schema).select(filters.matches_filter(filters.search_terms("title"), F.col("categories"), F.col("employer")).alias("m"))
    assert [r["m"] for r in got.collect()] == [True, True, False, False, True, False]


def test_identity(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, identity.keep_first(df, ["k"], "o").collect())) == [("a", 1, "y", 2), ("b", 3, None, 1)]


def test_reconcile_closes_after_two_omissions(spark):
    empty = spark.createDataFrame([], "id string, present boolean, omissions int, open boolean")
    here, none = spark.createDataFrame([("r",)], "id string"), spark.createDataFrame([], "id string")
    state, seen = empty, []
    for snapshot in (here, none, none, none, here):
        state = reconcile.reconcile(state, snapshot, ["id"])
        row = state.first()
        seen.append((row["present"], row["omissions"], row["open"], row["change"]))
        state = spark.createDataFrame([tuple(row)[:4]], "id string, present boolean, omissions int, open boolean")
    assert seen == [(True, 0, True, "new"), (False, 1, True, "omitted"), (False, 2, False, "closed"), (False, 2, False, "unchanged"), (True, 0, True, "returned")]
