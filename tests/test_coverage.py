"""Companies under all their names, with expected values written out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import coverage


@pytest.mark.parametrize("name, want", [("★ Acme, Inc.", "acme"), ("AT&T Corp", "at and t"), ("Société Générale Ltd", "societe generale"), ("Inc", "inc"), ("—", ""), (None, ""), ("Foo Company Co LLC", "foo")])
def test_keys(spark, name, want):
    assert spark.range(1).select(coverage.company_key(F.lit(name).cast("string"))).first()[0] == want


def aliases(spark, *pairs):
    return spark.createDataFrame(list(pairs), "alias string, name string")


def test_aliases_lead_to_one_name(spark):
    got = {r["name"]: r["company"] for r in coverage.alias_names(aliases(spark, ("TikTok", "ByteDance"), ("Douyin Inc", "TikTok"), ("Ring A", "Ring B"), ("ring b", "ring a"), ("Self", "SELF"), ("x", "Two"), ("x", "One"))).collect()}
    assert got == {"tiktok": "bytedance", "douyin": "bytedance", "bytedance": "bytedance", "ring a": "ring a", "ring b": "ring a", "x": "one", "one": "one", "two": "one"}


def test_states_by_precedence_and_search(spark):
    feeds = spark.createDataFrame([("Acme", "f1", "s1", 2), ("ACME Inc", "f2", "s1", 1), ("Douyin", "f1", "s2", 1), ("Quiet", "f1", "s1", 0), ("Shade", "f1", "s1", 5)], "name string, source_id string, season string, listings long")
    boards = spark.createDataFrame([("TikTok", "b1", "lever", "published"), ("ByteDance", "b2", "ashby", "shadow"), ("Shade", "b3", "lever", "shadow"), ("!!", "b4", "lever", "published")], "name string, source_id string, provider string, status string")
    seeds = spark.createDataFrame([("Seeded Ltd", True)], "name string, seed boolean")
    out = coverage.company_coverage(coverage.observations(feeds, boards, seeds), aliases(spark, ("TikTok", "ByteDance"), ("Douyin", "TikTok"))).cache()
    got = {r["company_id"]: (r["state"], r["listings"], r["source_ids"], r["direct_sources"]) for r in out.collect()}
    assert got == {
        "acme": ("feed-observed", 3, ["f1", "f2"], []),
        "bytedance": ("direct-published", 1, ["f1"], ["ashby:b2:shadow", "lever:b1:published"]),
        "quiet": ("candidate-only", 0, [], []),
        "shade": ("direct-shadow", 5, ["f1"], ["lever:b3:shadow"]),
        "seeded": ("candidate-only", 0, [], []),
    }
    assert coverage.coverage_counts(out).first().asDict() == {"companies": 5, "observed": 3, "direct_published": 1, "direct_shadow": 1, "feed_observed": 1, "candidate_only": 2, "listings": 9}
    assert [r["company_id"] for r in coverage.search_companies(out, state="candidate-only", size=0).collect()] == ["quiet"]
    assert [r["company_id"] for r in coverage.search_companies(out, "E", size=2, skip=1).collect()] == ["bytedance", "quiet"]
    assert [r["company_id"] for r in coverage.search_companies(out, "de", size=500).collect()] == ["seeded", "shade"]
