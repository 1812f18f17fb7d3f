"""Exact copies against grouping in plain Python and against the query's SQL."""

import hashlib
import re
from collections import defaultdict

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from gleaner.llm import exact

DOCS = "doc_id long, text string, source string, hash int, kept string"
ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (4, ""), (2, None), (7, "\n \r"), (8, "   "), (None, "a b\x0bc"), (None, "only here"), (None, "only here"), (11, "é" * 40_000), (10, "é" * 40_000), (12, "a b"), (13, "a b"), (3, "a b c")] + [(100 + i, f"word {i % 17}") for i in range(90)]


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for i, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        least = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, least, len(groups[t]), i == least, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,capacity", [(64, 20_000), (64, 3), (2, 3), (1, 1)])
def test_rows_equal_plain_groups_whatever_collides(spark, bits, capacity):
    df = spark.createDataFrame([(*r, "s", 1, "x") for r in ROWS], DOCS)
    got = exact.mark_exact_copies(df, capacity=capacity, bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_buckets_hold_their_capacity_and_chains_are_numbered(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 300).alias("text"))
    _, slots, entries = exact.build_index(df, capacity=20)
    depth = slots.agg(F.max("depth")).first()[0]
    assert slots.count() == 1 << depth and slots.select("slot").distinct().count() == 1 << depth
    assert max(r["count"] for r in entries.groupBy("bucket").count().collect()) <= 20
    assert entries.count() == 300
    _, _, entries = exact.build_index(df, capacity=20, bits=3)
    links = defaultdict(list)
    for r in entries.collect():
        links[r["hash"]].append(r["link"])
    assert len(links) == 8 and all(sorted(x) == list(range(1, len(x) + 1)) for x in links.values())


def test_kept_rows_are_whole_and_once(spark):
    rows = [(*r, "s", i, "x") for i, r in enumerate(ROWS)]
    got = exact.drop_exact_copies(spark.createDataFrame(rows, DOCS)).collect()
    want = {(i, least) for i, least, _, kept, _ in expected(ROWS) if kept}
    assert len(got) == len(want) == len({tuple(r) for r in got})
    assert {r["doc_id"] for r in got} == {i for i, _ in want}
    assert all(tuple(r) in rows for r in got)


def test_empty_table_and_query(spark, sf_dir):
    assert exact.mark_exact_copies(spark.createDataFrame([], DOCS)).count() == 0
    assert_same(exact.op12_exact_copies(spark, sf_dir), exact.OP12_SQL, sf_dir)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = exact.op12_exact_copies(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
