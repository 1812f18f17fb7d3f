"""Evidence rules: each one broken alone, with expected values written out by hand."""

import json

import pytest

from gleaner.operators import promotion

NOW, DAY = 1_000_000, 86_400
CLEAN = {"approved_by": "me", "approved_at": NOW - 10, "quiet_baseline": True, "stable_identity": True, "stable_hosts": True, "override_reason": None, "override_until": None}
RUN = {"succeeded": True, "complete": True, "identity_verified": True, "schema_valid": True, "raw_rows": 5, "eligible_rows": 3, "withheld_rows": 1, "links_checked": 3, "link_failures": 0}


def runs(n=3, step=DAY, **more):
    return [{"run_id": f"r{i}", "completed_at": NOW - 20 - step * (n - 1 - i)} | RUN | (more if i == n - 1 else {}) for i in range(n)]


CASES = [
    ({}, runs(), []), ({"approved_by": " "}, runs(), ["no-approver"]), ({"approved_at": None}, runs(), ["approval-time-invalid"]), ({"approved_at": NOW + 301}, runs(), ["approved-in-future"]), ({"quiet_baseline": False}, runs(), ["baseline-not-approved"]),
    ({"stable_identity": None}, runs(), ["identity-not-stable"]), ({"stable_hosts": False}, runs(), ["hosts-not-stable"]), ({}, runs(2), ["too-few-snapshots"]), ({}, runs(3, 100), ["span-too-short"]), ({"approved_at": NOW - 30}, runs(), ["approved-before-snapshot"]),
    ({"override_reason": "x", "override_until": NOW + 5}, runs(1), []), ({"override_reason": "x", "override_until": NOW + 5}, [], ["too-few-snapshots"]), ({"override_reason": " ", "override_until": NOW + 5}, runs(1), ["override-without-reason"]), ({"override_reason": "x", "override_until": NOW - 5}, runs(1), ["override-overdue", "too-few-snapshots"]),
    ({"override_reason": "x", "override_until": NOW - 11}, runs(), ["override-before-approval"]), ({"override_reason": "x"}, runs(), ["override-time-invalid"]), ({}, runs(run_id="r0"), ["runs-not-unique"]), ({}, runs(completed_at=None), ["snapshot-time-invalid"]),
    ({}, runs(succeeded=False), ["r2: not-succeeded"]), ({}, runs(links_checked=2), ["r2: links-not-checked-once"]), ({}, runs(link_failures=1), ["r2: link-failure-rate"]), ({}, runs(withheld_rows=9), ["r2: more-rows-than-raw"]), ({}, runs(withheld_rows=-1), ["r2: counts-invalid"]), ({}, runs(link_failures=4), ["r2: link-failure-rate", "r2: more-failures-than-links"]),
]


def test_every_rule(spark):
    columns = lambda schema: [x.split()[0] for x in schema.split(", ")]
    p = [tuple(({"source_id": str(i)} | CLEAN | more)[c] for c in columns(promotion.PROMOTION)) for i, (more, _, _) in enumerate(CASES)]
    s = [tuple(({"source_id": str(i)} | r)[c] for c in columns(promotion.SNAPSHOT)) for i, (_, rs, _) in enumerate(CASES) for r in rs]
    sources = [(str(i), "published") for i in range(len(CASES))] + [("shadow", "shadow"), ("bare", "published")]
    got = {r["source_id"]: r["violations"] for r in promotion.promotion_violations(spark.createDataFrame(sources, "source_id string, status string"), spark.createDataFrame(p, promotion.PROMOTION), spark.createDataFrame(s, promotion.SNAPSHOT), NOW).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(CASES)} | {"shadow": [], "bare": ["no-evidence"]}


def test_evidence_folders(spark, tmp_path):
    for site in ("a", "b"):
        (tmp_path / site).mkdir()
        (tmp_path / site / "evidence.json").write_text(json.dumps({"approved_by": site}))
    got = promotion.read_evidence(spark, f"{tmp_path}/*/evidence.json", "approved_by string").collect()
    assert sorted(map(tuple, got)) == [("a", "a", "evidence.json"), ("b", "b", "evidence.json")]
    (tmp_path / "b" / "evidence.json").write_text("{broken")
    with pytest.raises(Exception):
        promotion.read_evidence(spark, f"{tmp_path}/*/evidence.json", "approved_by string").collect()
