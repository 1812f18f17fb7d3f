"""Failures, dispatch, checklists, applications and times, with expected values written out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import times
from gleaner.functions.hashing import fnv_bucket
from gleaner.operators import applications, dispatch, failures, timing

WINDOW = 1800


def test_failures(spark):
    cases = [
        (None, None, "Bad SHAPE", "json", "invalid_schema", "schema"), ("json", None, "pagination broke", "json", "incomplete_pagination", "schema"), (None, None, "2 eligible roles lack a link", "link", "failed", "link"), (None, None, "suspicious zero-row", "quality", "unexpected_raw_zero", "quality"),
        (None, None, "ECONNRESET", "transport", "temporary_provider_error", "fetch"), (None, None, "https://schema.org/fetch", "persistence", "catalog_write_failed", "persistence"), (None, None, None, "persistence", "catalog_write_failed", "persistence"), ("http", 429, "", "http", "rate_limited", "fetch"),
        ("identity", 404, "", "identity", "not_found", "identity"), ("identity", 403, "", "identity", "application_host_mismatch", "identity"), ("link", 500, "", "link", "temporary_provider_error", "link"), ("empty", None, "", "empty", "unexpected_raw_zero", "empty"), ("http", 403, "", "http", "temporary_provider_error", "fetch"),
    ]
    c = F.col
    rows = spark.createDataFrame([(i, *case[:3]) for i, case in enumerate(cases)], "i int, given string, status int, message string").withColumn("category", failures.failure_category(c("given"), c("message")))
    got = {r[0]: tuple(r)[1:] for r in rows.select("i", "category", failures.failure_outcome(c("category"), c("status"), c("message")), failures.run_failure(c("category"))).collect()}
    assert [got[i] for i in range(len(cases))] == [case[3:] for case in cases]
    names = spark.createDataFrame([("ashby-a",), ("lever-a",), ("shadow-greenhouse-a",), ("shadow-lever-a",), ("",), (None,)], "s string")
    provider = failures.provider_of(c("s"))
    assert [tuple(r) for r in names.select(provider, failures.region_of(provider)).collect()] == [("ashby", "global"), ("lever", "global"), ("greenhouse", "unknown"), ("github", "unknown"), ("unknown", "unknown"), ("unknown", "unknown")]


def test_due_sources(spark):
    now = 1_000 * WINDOW + 60
    sources = spark.createDataFrame([(s, "published" if s.startswith("p") else "shadow") for s in ("p", "paused", "pback", "old", "late", "new", "timeless", "kept", "bare")], "source_id string, status string")
    health = [("paused", True, None, None, None), ("pback", False, now + 1, None, None), ("old", None, now - 5, now - 6 * WINDOW, None), ("late", None, None, now - 5 * WINDOW, None), ("timeless", None, None, None, None), ("p", None, now, None, None)]
    checkpoints = [("shadow-kept", now - 5 * WINDOW), ("bare", now - 9 * WINDOW)]
    h, k = spark.createDataFrame(health, "source_id string, paused boolean, backoff_until long, last_attempt_at long, last_success_at long"), spark.createDataFrame(checkpoints, "source_id string, last_success_at long")
    bucket = {r[0]: r[1] for r in sources.select("source_id", fnv_bucket(F.col("source_id"), 6)).collect()}
    for at in (now, now + WINDOW):
        fresh = {s for s in ("new", "bare") if bucket[s] == at // WINDOW % 6}  # a checkpoint under a shadow source's plain id is not its own
        want = {"p", "old", "timeless"} | fresh | ({"late", "kept", "pback"} if at > now else set())
        assert {r[0] for r in dispatch.due_sources(sources, k, h, at).collect()} == want
    assert dispatch.due_sources(sources.limit(0), k, h, now).collect() == []


def test_split_writes(spark):
    jobs, notes = spark.createDataFrame([(1,), (2,), (3,)], "job int"), spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "job int, event_id string")
    quiet, alerting, orphaned = dispatch.split_writes(jobs, notes, "job")
    assert sorted(r[0] for r in quiet.collect()) == [2, 3] and [(r[0], r[1]["event_id"]) for r in alerting.collect()] == [(1, "b")] and [tuple(r) for r in orphaned.collect()] == [(9, "c")]


def test_checklists(spark):
    items = spark.createDataFrame([("b", 1), ("a", 0)], "item string, position int")
    done = spark.createDataFrame([("p1", "a"), ("p1", "a"), ("p1", "x"), ("p2", "a"), ("p2", "b"), ("p3", None)], "period string, item string")
    out = dispatch.checklists(items, done)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {"p1": (1, 2, False, ["b"]), "p2": (2, 2, True, []), "p3": (0, 2, False, ["a", "b"])}
    said = {r[0]: tuple(r)[1:] for r in out.select("period", dispatch.reminder(F.col("pending"), F.lit(0)), dispatch.reminder(F.col("pending"), dispatch.attention(*map(F.lit, (1, 0, None, 2, 0, 50))))).collect()}
    assert said == {"p1": ("1 monitoring checks pending", "1 monitoring checks pending · 4 signals need review"), "p2": (None, None), "p3": ("2 monitoring checks pending", "2 monitoring checks pending · 4 signals need review")}


def test_applications(spark):
    uuid = "12345678-90ab-4cde-8f01-234567890abc"
    urls = {
        "https://www.linkedin.com/x": "destination-policy-prohibits-automation", "https://notlinkedin.com/x": "destination-not-reviewed", "https://boards.greenhouse.io/a/jobs/1": "greenhouse-headed-pilot", "https://evil-boards.greenhouse.io.test/": "destination-not-reviewed",
        "https://jobs.lever.co/a/1/apply": "lever-headed-pilot", "https://jobs.lever.co/a/1": "destination-not-reviewed", f"https://jobs.ashbyhq.com/Acme/{uuid}/application?x=1": "ashby-headed-pilot", f"https://jobs.ashbyhq.com/acme/{uuid}/application": "destination-not-reviewed",
        f"https://u@jobs.ashbyhq.com/Acme/{uuid}/application": "destination-not-reviewed", "nothing": "destination-not-reviewed",
    }
    jobs = spark.createDataFrame([(u, "c", "t", "l", "s", u, True) for u in urls], "job_id string, company string, title string, location string, season string, apply_url string, open boolean")
    apps = spark.createDataFrame([(u, "saved", None) for u in urls] + [("gone", "saved", None), ("nothing", "offer", "partner")], "job_id string, status string, apply_mode string")
    boards = spark.createDataFrame([("Acme",), ("Acme",)], "board string")
    got = {r["job_id"]: r for r in applications.summaries(apps, jobs, boards, status="saved").collect()}
    assert {u: r["assistance"]["reason"] for u, r in got.items() if r["job"]} == urls and got["gone"]["job"] is None and got["gone"]["assistance"] is None
    assert [r["assistance"]["eligibility"] for r in applications.summaries(apps, jobs, boards, status="offer").collect()] == ["partner-only"] and applications.summaries(apps, jobs, boards).count() == 12
    with pytest.raises(ValueError):
        applications.summaries(apps, jobs, boards, status="hired")


def test_digest_lines(spark):
    schema = "company string, title string, location string, apply_url string, open boolean, pending boolean, rank int"
    jobs = spark.createDataFrame([("A<", "t", "l", "u?a&b", True, True, 2), ("B", "t", "l", "u", True, True, 1), ("C", "t", "l", "u", False, True, 0), ("D", "t", "l", "u", True, False, 0)], schema)
    got = applications.digest_lines(jobs, "pending", [F.col("rank")]).collect()
    assert [r["text"] for r in got] == ["B — t (l)\nu", "A< — t (l)\nu?a&b"] and got[1]["html"] == '<li><strong>A&lt;</strong> — t (l)<br><a href="u?a&amp;b">Apply</a></li>'


def test_times(spark):
    texts = {"2024-02-29": True, "2023-02-29": False, "2024-01-01T10:00:00Z": True, "2024-01-01T10:00:00.123+02:00": True, "2024-01-01T10:00:00": False, "2024-01-01T25:00:00Z": False, "Jan 1, 2024": False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", times.absolute_time(F.col("t")), times.is_published_time(F.col("t"))).collect()}
    assert got == {t: (t if ok else None, ok and "T" in t) for t, ok in texts.items()}
    headers = spark.createDataFrame([("120",), (" 1.5 ",), ("Thu, 01 Jan 1970 00:05:00 GMT",), ("Thu, 01 Jan 1970 00:00:10 GMT",), ("soon",), ("-3",), (None,)], "h string")
    assert [r[0] for r in headers.select(times.retry_after_seconds(F.col("h"), F.lit(60))).collect()] == [120.0, 1.5, 240.0, 0.0, None, None, None]


def test_posting_times(spark):
    refs = [
        ("a", 0, "github-x", None, "2024-01-01", None, None), ("a", 1, "lever-x", None, None, "2024-01-05T00:00:00Z", "published"), ("b", 0, "lever-x", None, "2024-01-01", None, None), ("b", 1, "site", "https://raw.githubusercontent.com/x", "2024-01-03", None, None), ("b", 2, "ashby-x", None, None, "2024-01-02", "updated"),
        ("c", 0, "lever-x", None, "2024-01-01", "not a date", "published"), ("e", 0, "site", None, None, "2024-01-09", "published"), ("a", 2, "Ashby-y", None, None, None, None),
    ]
    refs = spark.createDataFrame(refs, "job string, position int, source_id string, source_url string, posted_at string, provider_time string, semantics string")
    jobs = spark.createDataFrame([("a", "2024-02-01"), ("b", None), ("c", "2024-02-01"), ("d", "lately"), ("e", None)], "job string, first_seen_at string")
    times_of = timing.posting_timing(jobs, refs, "job")
    assert {r[0]: tuple(r)[1:] for r in times_of.collect()} == {"a": ("employer-posted", "2024-01-05T00:00:00Z"), "b": ("source-reported", "2024-01-03"), "c": ("found", "2024-02-01"), "d": ("unknown", None), "e": ("source-reported", "2024-01-09")}
    now = F.unix_timestamp(F.lit("2024-02-03 00:00:00"))
    said = times_of.join(jobs, "job").select("job", timing.timing_text(F.col("kind"), F.col("timestamp"), F.col("first_seen_at"), now, "us").alias("t"))
    assert {r["job"]: tuple(r["t"]) for r in said.collect()} == {
        "a": ("Employer posted Jan 5, 2024", "Employer posted Jan 5, 2024 · Verified employer date · Found by us Feb 1, 2024"), "b": ("Source reported Jan 3, 2024", "Source reported Jan 3, 2024 · Not employer-verified"),
        "c": ("Found by us 2d ago", "Original posting date unavailable · Found by us Feb 1, 2024"), "d": ("Posting time unavailable", "Original posting date unavailable"), "e": ("Source reported Jan 9, 2024", "Source reported Jan 9, 2024 · Not employer-verified"),
    }
    assert {r[0]: tuple(r)[1:] for r in timing.source_text(refs, "job").collect()} == {
        "a": ("Official employer source · Lever + Ashby", "Also corroborated by a community listing"), "b": ("Official employer source · Lever + Ashby", "Also corroborated by a community listing"), "c": ("Official employer source · Lever", None), "e": ("Community listing", None),
    }


def test_split_writes_takes_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(dispatch, "TASK_ROWS", 10, raising=False)
    jobs = spark.range(600).withColumnRenamed("id", "job")
    notes = spark.range(400).selectExpr("2 * id job", "id event_id")
    quiet, alerting, orphaned = dispatch.split_writes(jobs, notes, "job")
    assert (quiet.count(), alerting.count(), orphaned.count()) == (300, 300, 100)
    assert all(df.rdd.getNumPartitions() >= 100 for df in (quiet, alerting, orphaned))
