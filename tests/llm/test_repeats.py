"""Repeated strings of production length against brute force, with anchors that very many texts share."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import repeats

LEAST = 400


def _texts():
    rnd = random.Random(7)

    def words(n):
        return "".join(rnd.choice("abcdefghijklmnop \u00e9") for _ in range(n))

    passages = {n: "".join(rnd.choice("qrstuvwxyz ") for _ in range(n)) for n in (170, 300, 399, 400, 900)}
    rows = [(0, None), (1, ""), (2, "x" * 399), (3, "y" * 1000)]
    for n, passage in passages.items():
        rows += [(len(rows) + i, words(rnd.randint(0, 500)) + passage + words(rnd.randint(0, 500))) for i in range(25)]
    rows += [(len(rows), rows[40][1]), (None, rows[60][1]), (None, "z" + rows[60][1])]
    return rows + [rows[50], rows[50]]


def _check_against_brute_force(spark):
    rows = _texts()
    seen = Counter(d[j : j + LEAST] for d in ((t or "").encode() for _, t in rows) for j in range(len(d) - LEAST + 1))

    def expected(doc_id, text):
        d = (text or "").encode()
        gone = {x for j in range(len(d) - LEAST + 1) if seen[d[j : j + LEAST]] > 1 for x in range(j, j + LEAST)}
        return doc_id, len(d), len(gone), sum(x - 1 not in gone for x in gone), hashlib.sha256(bytes(c for j, c in enumerate(d) if j not in gone)).hexdigest()

    got = repeats.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), LEAST).collect()
    assert Counter(map(tuple, got)) == Counter(expected(*r) for r in rows)


def test_repeats_of_production_length(spark):
    _check_against_brute_force(spark)


def test_no_task_holds_a_hot_anchor(spark, monkeypatch):
    largest, indexed = [], repeats._indexed

    def watched(strings, least):
        largest.append(strings.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return indexed(strings, least)

    monkeypatch.setattr(repeats, "HOT_BYTES", 3000)
    monkeypatch.setattr(repeats, "_indexed", watched)
    _check_against_brute_force(spark)
    assert len(largest) == 5  # the segments, and parts by widths of 60, 15, 3 and 1
    assert 0 < max(largest) <= 3000
