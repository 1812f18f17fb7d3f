"""Saved filters: matches, reasons and fan-out, with expected values written out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import delivery, filters, gates
from gleaner.functions import times

CATEGORIES = {"ai-ml": r"machine learning|ml|ai", "swe": r"software|swe|developer"}
LABELS = {"ai-ml": "AI/ML", "swe": "Software engineering"}
SCHEMA = f"job int, value string, categories array<string>, employer string, citizen boolean, degree boolean, user string, filter struct<{', '.join(x.replace(' ', ':', 1) for x in filters.FILTER.split(', '))}>"


def row(value, categories=(), employer="normal", citizen=None, degree=None, **f):
    names = [x.split()[0] for x in filters.FILTER.split(", ")]
    return (1, value, list(categories), employer, citizen, degree, "u", tuple(f.get(n) for n in names))


def evaluated(spark, *rows):
    e = filters.evaluate_filter(F.col("value"), F.col("categories"), F.col("employer"), requirements=(F.col("citizen"), F.col("degree")), category_labels=LABELS, employer_labels={"startup": "Startups"})
    return [(r["e"]["matches"], [tuple(x) for x in r["e"]["reasons"]], r["e"]["exclusions_applied"]) for r in spark.createDataFrame(list(rows), SCHEMA).coalesce(1).select(e.alias("e")).collect()]


def test_reasons_come_in_order_and_once(spark):
    got = evaluated(
        spark,
        row("acme ml robotics intern", ["ai-ml"], "startup", include_keywords=[" Robotics ", "ROBOTICS", "none"], include_categories=["ai-ml", "swe"], include_employers=["startup"]),
        row("acme intern"),
        row("acme intern", employer="startup", include_employers=["startup"], exclude_keywords=["senior"]),
        row("acme intern", include_keywords=["robotics"]),
        row("senior ml intern", ["ai-ml"], include_categories=["ai-ml"], exclude_keywords=["senior"]),
        row("ml intern", ["ai-ml"], exclude_categories=["ai-ml"]),
        row("acme intern", include_employers=["faang"]),
    )
    assert got == [
        (True, [("category", "AI/ML"), ("keyword", "Robotics"), ("company-type", "Startups")], False),
        (True, [("default-all-technical", "All technical roles")], False),
        (True, [("default-all-technical", "All technical roles"), ("company-type", "Startups")], True),
        (False, [], False),
        (False, [], True),
        (False, [], True),
        (False, [], False),
    ]


def test_requirements_fall_back_to_the_text(spark):
    got = evaluated(
        spark,
        row("intern must be a u.s. citizen", exclude_citizenship=True),
        row("intern must be a u.s. citizen", citizen=False, degree=False, exclude_citizenship=True),
        row("intern 🎓", exclude_degree=True),
        row("research intern", degree=True, exclude_degree=True),
        row("research intern 🇺🇸", exclude_degree=True),
    )
    assert [x[0] for x in got] == [False, True, False, False, True]


def test_parsing_keeps_what_is_supplied():
    parse = lambda v: filters.parse_filter(v, list(CATEGORIES), ["faang", "startup", "normal"])
    assert parse(None) is None and parse({}) == {}
    assert parse({"includeKeywords": ["a"], "excludeAdvancedDegreeRequired": True}) == {"include_keywords": ["a"], "exclude_degree": True}
    for bad in ([], "x", {"includeKeywords": "a"}, {"includeKeywords": [" "]}, {"includeCategories": ["cooking"]}, {"excludeEmployerCategories": ["big"]}, {"excludeUsCitizenshipRequired": "yes"}):
        with pytest.raises(ValueError):
            parse(bad)


def test_candidates_miss_no_match_and_alerts_respect_receipts(spark):
    names = [x.split()[0] for x in filters.FILTER.split(", ")]
    jobs = spark.createDataFrame([(1, "ml robot intern", ["ai-ml"], "normal"), (2, "ai c intern", ["ai-ml"], "startup"), (3, "cook", [], "normal")], "job int, value string, categories array<string>, employer string")
    wanted = {"a": {"include_keywords": ["ROB"]}, "b": {"include_keywords": ["c"]}, "c": {"include_categories": ["ai-ml"]}, "d": {}, "e": {"include_keywords": ["absent", "zzz"]}, "f": {"include_keywords": ["robot intern"], "exclude_keywords": ["ml"]}, "g": {}}
    saved = spark.createDataFrame([(u, u != "g", True, tuple(f.get(n) for n in names)) for u, f in wanted.items()], "user string, alerts_enabled boolean, onboarding_complete boolean, " + SCHEMA[SCHEMA.index("filter struct"):])
    found = filters.filter_candidates(jobs, "job", "value", "categories", saved, "user")
    assert sorted((r["job"], r["user"]) for r in found.collect()) == [(1, "a"), (1, "c"), (1, "d"), (1, "f"), (1, "g"), (2, "b"), (2, "c"), (2, "d"), (2, "g"), (3, "b"), (3, "d"), (3, "g")]
    devices = spark.createDataFrame([(u, f"t{u}", True) for u in "abcdefg"] + [("a", "old", False)], "user string, token string, active boolean")
    receipts = spark.createDataFrame([(1, "a", "ta", "ok", 1), (1, "c", "tc", "error", 2), (2, "c", "tc", "retryable", 1), (2, "d", "td", "pending", 1)], "job int, user string, token string, status string, attempts int")
    sent = filters.alerts_to_send(jobs, "job", saved, "user", devices, receipts, filters.evaluate_filter(F.col("value"), F.col("categories"), F.col("employer")), found)
    assert sorted((r["job"], r["user"], r["attempts"]) for r in sent.collect()) == [(1, "c", 3), (1, "d", 1), (2, "b", 1), (3, "b", 1), (3, "d", 1)]


def test_receipts_end_after_three_attempts(spark):
    receipts = spark.createDataFrame([(k, n) for k, n in enumerate((None, 1, 2, 3))], "id int, attempts int")
    tickets = spark.createDataFrame([(k, "MessageRateExceeded") for k in range(4)], "id int, result string")
    assert [r["status"] for r in delivery.settle(receipts, tickets, "id").orderBy("id").collect()] == ["retryable", "retryable", "retryable", "error"]


def test_quarantine_asks_for_the_category(spark):
    cases = [("http", 404, 1, True), ("transport", 404, 1, False), (None, 404, 5, False), ("link", None, 1, False), ("link", None, 2, True), ("json", None, 1, True), ("http", 500, 9, False)]
    df = spark.createDataFrame(cases, "category string, status int, failures int, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", gates.quarantined(F.col("category"), F.col("status"), F.col("failures")).alias("got")).collect())


def test_ages(spark):
    cases = [(30, "just now", "Confirmed today"), (300, "5m ago", "Confirmed today"), (7200, "2h ago", "Confirmed today"), (86400, "1d ago", "Confirmed yesterday"), (6 * 86400, "6d ago", "Confirmed 6 days ago"), (7 * 86400, "Jan 5, 2024", "Confirmed Jan 5, 2024"), (-5, "just now", "Confirmed today")]
    at = F.to_timestamp(F.lit("2024-01-05 10:00:00"))
    for seconds, age, label in cases:
        got = spark.range(1).select(times.compact_age(F.lit(seconds), at), times.freshness_label(F.lit(seconds), at)).first()
        assert tuple(got) == (age, label)


def test_fan_out_gives_the_alerts_and_joins_no_pairs_with_receipts(spark):
    names = [x.split()[0] for x in filters.FILTER.split(", ")]
    jobs = spark.createDataFrame([(1, "ml robot intern", ["ai-ml"], "normal"), (2, "ai c intern", ["ai-ml"], "startup"), (3, "cook", [], "normal")], "job int, value string, categories array<string>, employer string")
    wanted = {"a": {"include_keywords": ["ROB"]}, "b": {"include_keywords": ["ROB"]}, "c": {"include_categories": ["ai-ml"]}, "d": {}, "e": {}, "f": {"include_keywords": ["c"], "exclude_keywords": ["ai"]}, "g": {}, "h": {"include_categories": ["ai-ml"]}}
    saved = spark.createDataFrame([(u, u != "g", True, tuple(f.get(n) for n in names)) for u, f in wanted.items()], "user string, alerts_enabled boolean, onboarding_complete boolean, " + SCHEMA[SCHEMA.index("filter struct"):])
    devices = spark.createDataFrame([(u, f"t{u}", True) for u in "abcdefgh"] + [("a", "two", True), ("c", "old", False)], "user string, token string, active boolean")
    receipts = spark.createDataFrame([(1, "a", "ta", "ok", 1), (1, "c", "tc", "error", 2), (2, "c", "tc", "retryable", 1), (2, "d", "td", None, None), (3, "e", "te", "pending", 1)], "job int, user string, token string, status string, attempts int")
    e = filters.evaluate_filter(F.col("value"), F.col("categories"), F.col("employer"))
    sent = filters.fan_out(jobs, "job", "value", "categories", saved, "user", devices, receipts, e)
    plain = filters.alerts_to_send(jobs, "job", saved, "user", devices, receipts, e, filters.filter_candidates(jobs, "job", "value", "categories", saved, "user"))
    seen = lambda df: sorted((r["job"], r["user"], r["token"], r["attempts"], str(r["reasons"])) for r in df.collect())
    assert seen(sent) == seen(plain)
    assert [x[:4] for x in seen(sent)] == [
        (1, "a", "two", 1), (1, "b", "tb", 1), (1, "c", "tc", 3), (1, "d", "td", 1), (1, "e", "te", 1), (1, "h", "th", 1),
        (2, "d", "td", 1), (2, "e", "te", 1), (2, "h", "th", 1), (3, "d", "td", 1), (3, "f", "tf", 1),
    ]


def test_fan_out_broadcasts_no_listings_and_tells_reasons_before_there_are_pairs(spark, sf_dir):
    from gleaner.plans import registry

    plan = registry.QUERIES["filter_fan_out"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [min((i for i, c in enumerate(x) if c.isalpha()), default=0) for x in plan]
    under = lambda i: next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
    for i in (i for i, x in enumerate(plan) if "BroadcastExchange" in x):
        assert not [x for x in plan[i : under(i)] if "part.parquet" in x]
    pairs = next(i for i, x in enumerate(plan) if "_part#" in x and "Join" in x)
    assert not [x for x in plan[:pairs] if "array_join" in x]


def test_fan_out_in_several_rounds_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(filters, "FOLLOWERS", 3)
    test_fan_out_gives_the_alerts_and_joins_no_pairs_with_receipts(spark)
