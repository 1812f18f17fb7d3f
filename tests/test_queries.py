import pytest
from oracle import assert_same

from gleaner.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fnv_bucket_is_fnv(spark, sf_dir):
    def bucket(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h % 6

    for r in registry.QUERIES["shadow_bucket_fnv"](spark, sf_dir).collect():
        assert r["bucket"] == bucket(r["source"])
