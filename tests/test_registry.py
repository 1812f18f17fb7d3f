"""Registry gates, lookups, sightings and migrations, with expected values written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ledger, migrations, occurrences, registry, versions

NOW, DAY = 1_000 * 86_400, 86_400
ROW = {"source_id": "lever-acme", "position": 1, "board": "acme", "company": "Acme", "careers_url": "https://www.acme.com/careers", "admitted_at": NOW - DAY, "region": "global", "status": "published", "evidence_status": "agent-verified"}
PROOF = {
    "folder": "acme", "malformed": False, "board": "acme", "company": "Acme", "careers_url": "https://www.acme.com/careers", "page_url": "https://acme.com/join", "excerpt": '<a href="https://jobs.lever.co/acme">', "job_url": "https://jobs.lever.co/acme/1/apply", "hosts": ["jobs.lever.co"],
    "region": "global", "state": "ownership-verified", "verified_at": NOW - DAY, "notes": None,
}
PROBE = {"folder": "acme", "malformed": False, "board": "acme", "state": "ok", "attribution": "unattributed", "region": "global", "url_violations": 0, "malformed_rows": 0, "hosts": ["jobs.lever.co"], "n_results": 1, "probed_at": 1}
POLICY = {"source_id": "lever-acme", "source_class": "lever", "board": "acme"}


def frame(spark, schema, *rows):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


#: (changes of the row, of the evidence, of the probe, of the policy, what is told); None leaves the document out.
CASES = [
    ({}, {}, {}, {}, []), ({"source_id": "x-acme"}, {}, {}, None, ["id-not-namespaced", "no-policy"]), ({}, {}, {}, {"source_class": "ashby"}, ["policy-class"]), ({}, {}, {}, {"board": "other"}, ["policy-board"]),
    ({"admitted_at": NOW - 181 * DAY}, {"verified_at": NOW - 181 * DAY}, {}, {}, ["verification-overdue"]), ({"admitted_at": NOW - 180 * DAY}, {"verified_at": NOW - 180 * DAY}, {}, {}, []), ({"evidence_status": "legacy-review"}, None, None, {}, []),
    ({}, None, {}, {}, ["no-evidence"]), ({}, {}, None, {}, ["no-probe"]), ({}, {"malformed": True, "board": None}, None, {}, ["no-probe", "evidence-malformed"]), ({}, {"state": "ambiguous-owner"}, {}, {}, ["not-admissible"]), ({}, {"company": "Other"}, {}, {}, ["other-company"]),
    ({}, {"verified_at": NOW}, {}, {}, ["other-time"]), ({}, {"excerpt": "https://jobs.lever.co/acme-2"}, {}, {}, ["excerpt-without-board"]), ({}, {"excerpt": "see JOBS.LEVER.CO/acme/"}, {}, {}, []), ({}, {"excerpt": " "}, {}, {}, ["no-excerpt"]),
    ({}, {"page_url": "https://acme.co.uk/join"}, {}, {}, ["page-of-other-domain"]), ({}, {"page_url": "https://boards.lever.co/acme"}, {}, {}, ["page-foreign", "page-of-other-domain"]), ({}, {"hosts": ["jobs.lever.co", "acme.com"]}, {}, {}, ["hosts-outside"]), ({}, {"hosts": []}, {}, {}, ["no-hosts"]),
    ({}, {"job_url": "https://jobs.lever.co/acme"}, {}, {}, ["job-not-on-board"]), ({}, {}, {"state": "http-error"}, {}, ["probe-not-ok"]), ({}, {}, {"malformed_rows": None}, {}, ["probe-malformed-rows"]), ({}, {}, {"n_results": 2}, {}, ["probe-not-one-result"]), ({}, {}, {"hosts": None}, {}, ["probe-without-hosts"]),
]


def named(value, i):
    """A document of case ``i``: its own board and company in the place of acme."""
    if isinstance(value, dict):
        return {k: named(v, i) for k, v in value.items()}
    if isinstance(value, list):
        return [named(v, i) for v in value]
    return value.replace("acme", f"acme{i}") if isinstance(value, str) else value


def test_every_gate(spark):
    def all_of(schema, base, column):
        return frame(spark, schema, *(named(base | case[column], i) | ({"position": i} if column == 0 else {}) for i, case in enumerate(CASES) if case[column] is not None))

    args = all_of(registry.REGISTRY, ROW, 0), all_of(registry.EVIDENCE, PROOF, 1), all_of(registry.PROBE, PROBE, 2), all_of(registry.POLICY, POLICY, 3)
    got = {r["subject"]: list(r["violations"]) for r in registry.manifest_violations(*args, NOW).collect()}
    want = {named(row.get("source_id", "lever-acme"), i): told for i, (row, *_, told) in enumerate(CASES)}
    assert got == want


def test_repeated_rows_waiting_folders_and_folders_without_evidence(spark):
    rows = frame(spark, registry.REGISTRY, ROW, ROW | {"position": 2}, ROW | {"position": 3, "source_id": "lever-b"})
    proofs = frame(spark, registry.EVIDENCE, PROOF, PROOF | {"folder": "w", "board": "w", "excerpt": "jobs.lever.co/w", "job_url": "https://jobs.lever.co/w/1"}, PROOF | {"folder": "q", "state": "inconclusive", "excerpt": None})
    probes = frame(spark, registry.PROBE, PROBE, PROBE | {"folder": "w", "board": "w"}, PROBE | {"folder": "q", "board": "q", "state": "http-error"}, PROBE | {"folder": "bare"})
    policies = frame(spark, registry.POLICY, POLICY, POLICY | {"source_id": "lever-b"}, POLICY | {"source_id": "lever-gone"})
    got = sorted((r["subject"], list(r["violations"])) for r in registry.manifest_violations(rows, proofs, probes, policies, NOW).collect())
    assert got == [
        ("bare", ["folder-without-evidence"]), ("lever-acme", []), ("lever-acme", ["duplicate-id", "duplicate-board"]), ("lever-b", ["duplicate-board"]), ("lever-gone", ["policy-without-source"]),
        ("q", ["other-folder", "neither-excerpt-nor-notes"]), ("w", []),
    ]
    assert [(r["source_id"], r["status"]) for r in registry.pending_admission(rows, proofs).collect()] == [("lever-w", "shadow")]
    assert tuple(registry.manifest_summary(rows, proofs).first()) == (3, 3, 0, 3, 0, 1)


def test_empty_registry(spark):
    empty = [frame(spark, s) for s in (registry.REGISTRY, registry.EVIDENCE, registry.PROBE, registry.POLICY)]
    assert registry.manifest_violations(*empty, NOW).collect() == [] and tuple(registry.manifest_summary(*empty[:2]).first()) == (0,) * 6


def test_recheck(spark):
    pages = {"exact": '<p> <a  href="https://jobs.lever.co/acme">\n</p>', "link-only": "we hire at jobs.lever.co/acme?x", "missing": "jobs.lever.co/acme-labs"}
    proofs = [PROOF | {"folder": f, "page_url": f"https://acme.com/{f}"} for f in (*pages, "error", "silent")] + [PROOF | {"folder": "bad", "page_url": "https://acme.com/exact", "company": ""}]
    fetched = [(f"https://acme.com/{f}", 200, html) for f, html in pages.items()] + [("https://acme.com/error", 503, "x")]
    got = {r[0]: tuple(r)[1:] for r in registry.recheck(frame(spark, registry.EVIDENCE, *proofs), spark.createDataFrame(fetched, "page_url string, status int, html string")).collect()}
    assert got == {
        "exact": ("ok", "exact", True), "link-only": ("ok", "link-only", True), "missing": ("ok", "missing", False), "error": ("http-error", None, None), "silent": ("transport-error", None, None), "bad": ("malformed-record", None, None),
    }


def test_manifest_files(spark, tmp_path):
    for folder, text in (("a", json.dumps({"board": "a"})), ("b", "{broken")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "evidence.json").write_text(text)
    got = registry.read_manifest(spark, f"{tmp_path}/*/evidence.json", registry.EVIDENCE).select("folder", "malformed", "board").collect()
    assert sorted(map(tuple, got)) == [("a", False, "a"), ("b", True, None)]


SOURCES = "source_id string, token string, employer_id string, display_name string, aliases array<string>, careers_url string, expected_names array<string>, admitted_name string, admitted_at string, initial_hosts array<string>, final_hosts array<string>, host_reason string, status string, evidence_status string"
GOOD = ("greenhouse-acme", "acme", "acme", "Acme", ["Acme, Inc."], "https://acme.com/jobs", ["Ácme Labs"], "ACME labs!", "2026-07-27T21:13:00.000Z", ["boards.greenhouse.io"], ["careers.acme.com"], "own host", "shadow", None)


ERRORS = [
    (1, "Acme", "token-invalid"), (0, "greenhouse-b", "id-not-of-token"), (2, " ", "no-employer"), (4, [], "no-aliases"), (5, "acme", "careers-invalid"), (5, "http://acme.com", "careers-not-https"), (6, ["Acme Labs", " "], "expected-names"),
    (6, [], "expected-names"), (7, "Acme Labs Inc", "admitted-name"), (7, None, "admitted-name"), (8, "2026-07-27", "admission-time"), (8, "2026-13-27T00:00:00Z", "admission-time"), (9, [], "no-initial-hosts"), (10, ["a.com:8080"], "host-not-bare"), (10, ["evilgreenhouse.io"], None),
    (11, " ", "host-without-reason"), (12, "draft", "status"), (13, "guessed", "evidence-status"),
]


def test_config_errors(spark):
    rows = [tuple(value if j == at else named(v, i) for j, v in enumerate(GOOD)) for i, (at, value, _) in enumerate(ERRORS)]
    keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + SOURCES)
    got = {r["n"]: r["error"] for r in keyed.select("n", registry.config_error().alias("error")).collect()}
    assert [got[i] for i in range(len(ERRORS))] == [e for *_, e in ERRORS]


def test_registry_errors_and_lookup(spark):
    other = ("greenhouse-b", "b", "beta", "Beta", ["ACME Corp"], *GOOD[5:])
    rows = spark.createDataFrame([GOOD, GOOD, other], SOURCES)
    assert sorted(r["error"] for r in registry.registry_errors(rows).collect()) == ["duplicate-id", "duplicate-id"]
    with pytest.raises(ValueError):
        ledger.require_none(registry.registry_errors(rows), "invalid sources")
    asked = spark.createDataFrame([(q,) for q in (" greenhouse-b ", "beta LLC", "Acme", "nobody", "", "Inc", None)], "query string")
    got = {r["query"]: tuple(r)[1:] for r in registry.find_reviewed(asked, spark.createDataFrame([GOOD, other], SOURCES)).collect()}
    assert got == {
        " greenhouse-b ": ("found", "greenhouse-b", 1), "beta LLC": ("found", "greenhouse-b", 1), "Acme": ("ambiguous", None, 2), "nobody": ("unknown", None, 0), "": ("unknown", None, 0), "Inc": ("unknown", None, 0), None: ("unknown", None, 0),
    }


def test_seeding(spark):
    refs = [("j2", 0, "lever-a", None, "d1", "https://x.com/"), ("j1", 1, "lever-a", "d1", None, "u"), ("j1", 0, "list", "", "doc", "https://X.com/a/?utm_x=1"), ("j1", 2, "list", None, None, "https://x.com"), ("j3", 0, "list", None, "doc", "nothing"), ("j3", 1, "list", "old", None, "u")]
    there = spark.createDataFrame([("list", "old")], "source_id string, external_id string")
    seeds, counts = occurrences.seed_occurrences(spark.createDataFrame(refs, "job string, position int, source_id string, external_id string, document string, apply_url string"), there, spark.createDataFrame([("lever-a", "h")], "source_id string, content_hash string"))
    assert sorted((r["source_id"], r["external_id"], r["job"], r["changed_hash"]) for r in seeds.collect()) == [("lever-a", "d1", "j1", "h"), ("list", "doc:https://x.com/a", "j1", "backfill")]
    assert sorted(map(tuple, counts.collect())) == [("lever-a", 1, 1, 0), ("list", 1, 1, 2)]


@pytest.fixture
def jobs(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/jobs", migrations.JOBS, "job")
    names = [x.split()[0] for x in migrations.JOBS.split(", ")]
    base = dict.fromkeys(names) | {"company": "A", "title": "B", "location": "C", "open": True, "pending": False, "sent": False, "first_source": "ashby-a", "first_precision": "exact", "closed_pk": None, "direct": True, "community": True}
    rows = [base | {"job": j} | more for j, more in (("a", {}), ("b", {"sent": True}), ("c", {"first_source": "x"}), ("d", {"recency": "baseline"}), ("e", {"open": False, "closed_pk": "CLOSED"}), ("f", {"technical": False, "open_pk": "OPEN"}))]
    at = F.to_timestamp(F.lit("2026-08-09 10:00:00"))
    df = frame(spark, migrations.JOBS, *rows).withColumns({n: at for n in ("first_seen_at", "last_seen_at", "first_attached_at")})
    table.upsert(df)
    return table


def test_recency_migration(jobs):
    wrong = migrations.baseline_candidate("2026-08-09", ["ashby-a"])
    count, token = migrations.plan_recency(jobs, wrong)
    assert count == 3
    some, other = migrations.plan_recency(jobs, wrong, ["a", "e"])
    assert some == 2 and other != token
    for bad in (["a", "a"], ["a", "b"]):
        with pytest.raises(ValueError):
            migrations.plan_recency(jobs, wrong, bad)
    with pytest.raises(versions.Conflict):
        migrations.migrate_recency(jobs, wrong, some, token, ["a", "e"])
    migrations.migrate_recency(jobs, wrong, count, token)
    got = {r["job"]: r for r in jobs.read().collect()}
    assert {j for j in got if got[j]["recency"] == "baseline"} == {"a", "d", "e", "f"} and got["a"]["open_sk"] == "1#2026-08-09T10:00:00#a"
    assert (got["e"]["open_pk"], got["e"]["closed_pk"], got["f"]["open_pk"]) == (None, "CLOSED", None) and got["a"]["visible_at"] == got["a"]["first_seen_at"]
    with pytest.raises(versions.Conflict):
        migrations.migrate_recency(jobs, wrong, count, token)


def test_search_backfill(jobs):
    assert migrations.backfill_search(jobs) == 6 and migrations.backfill_search(jobs) == 0
    row = jobs.read().where("job = 'a'").first()
    assert row["search_text"] == "a b c" and row["classes"] == ["all", "direct", "community", "corroborated"]


def addresses_taken_apart(df) -> int:
    """How often the plan takes an address apart."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("^(?i)(https?)://")


def built(spark, schema, **changed):
    """An empty table of ``schema`` whose columns are computed, as a query computes them."""
    return frame(spark, schema).select(*(F.concat(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in (x.split() for x in schema.split(", "))))


def test_violations_take_each_address_apart_once(spark):
    rows, proofs, probes, policies = (built(spark, s) for s in (registry.REGISTRY, registry.EVIDENCE, registry.PROBE, registry.POLICY))
    # Three addresses of five patterns and the path of one, for rows and for folders that wait.
    assert 0 < addresses_taken_apart(registry.manifest_violations(rows, proofs, probes, policies, NOW)) <= 40


def test_waiting_folders_take_each_address_apart_once(spark):
    rows, proofs = built(spark, registry.REGISTRY), built(spark, registry.EVIDENCE)
    assert 0 < addresses_taken_apart(registry.pending_admission(rows, proofs)) <= 20
    assert 0 < addresses_taken_apart(registry.manifest_summary(rows, proofs)) <= 20
