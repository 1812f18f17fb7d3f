"""Long posting lists in pairs of blocks against all their pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import jaccard


def test_block_pairs_meet_once_and_stay_small(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 20)
    rnd = random.Random(3)
    sizes = [3, 4, 6, 8, 9, 12, 27, 36, 48, 64]  # many at exactly three quarters of another
    rows = [(1 + i % 2, rnd.choice(sizes), i, 1 + i % 3, rnd.choice((0, 1, 2, i)), bytes(64)) for i in range(300)]
    rows += [(9, 10, 1000 + i, 1, 0, bytes(64)) for i in range(100)]  # one component: nothing to compare
    groups = jaccard._block_pairs(spark.createDataFrame(rows, "token long, n int, node long, matches int, root long, sketch binary"), 75)
    assert groups.groupBy("token").count().agg(F.max("count")).first()[0] < 80  # of lists of 150
    schema = "token long, n int, node long, matches int, root long, sketch binary, side int, home int"
    assert groups.select(*[x.split()[0] for x in schema.split(", ")]).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    dealt = groups.withColumn("weight", F.lit(1).cast("long")).repartition("token").sortWithinPartitions("token", "n", "node")
    visits = dealt.mapInArrow(lambda b: jaccard._visits(b, 75), "x long, root long, lists long, need long")
    got = {(r["x"], r["root"]): r["need"] for r in visits.groupBy("x", "root").agg(F.min("need").alias("need")).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] < b[4] and 100 * min(a[1], b[1]) >= 75 * max(a[1], b[1]):
                rest = max(-(-75 * a[1] // 100) - a[3], -(-75 * b[1] // 100) - b[3])
                need = max(min(a[3], b[3]), -(-75 * (a[1] + b[1]) // 175) - rest)
                want[a[2], b[4]] = min(need, want.get((a[2], b[4]), need))
    assert got == want
    assert visits.count() < sum(len([b for b in rows if b[0] == a[0]]) for a in rows) / 2  # a task's lists are put together


def test_links_share_as_many_prefix_shingles_as_is_asked(spark):
    rnd = random.Random(11)
    rank = np.array([rnd.random() for _ in range(400)])
    asked = 0
    for _ in range(3000):
        base = rnd.sample(range(400), rnd.randint(4, 120))
        sets = [set(base) - set(rnd.sample(base, rnd.randint(0, len(base) // 6))) | set(rnd.sample(range(400), rnd.randint(0, 8))) for _ in range(2)]
        if 100 * len(sets[0] & sets[1]) < 75 * len(sets[0] | sets[1]):
            continue
        n, matches, prefixes = [], [], []
        for x in sets:
            l = rnd.randint(1, min(jaccard.MOST_MATCHES, -(-75 * len(x) // 100)))
            size = len(x) - -(-75 * len(x) // 100) + l
            n.append(np.array([len(x)]))
            matches.append(np.array([l]))
            prefixes.append(set(sorted(x, key=lambda t: rank[t])[:size]))
        need = int(jaccard.least_shared(n[0], matches[0], n[1], matches[1], 75)[0])
        assert len(prefixes[0] & prefixes[1]) >= need >= 1
        asked += need > min(matches[0][0], matches[1][0])
    assert asked > 100  # the bound asks for more than l often


def test_mixed_lists_keep_all_that_can_link(spark):
    rnd = random.Random(5)
    rows = [(t, rnd.choice((8, 9, 12, 30)), 100 * t + i, 1, rnd.choice((0, 1, 100 * t + i)), bytes(rnd.choice((0, 1)) for _ in range(64)), 0, 1) for t in range(40) for i in range(rnd.choice((2, 3, 12)))]
    schema = "token long, n int, node long, matches int, root long, sketch binary, side int, home int"
    frame = spark.createDataFrame(rows, schema).repartition("token").sortWithinPartitions("token", "n", "node")
    got = {(r["token"], r["node"]): r["near"] for r in frame.mapInArrow(lambda b: jaccard._mixed(b, 75), jaccard.MIXED).collect()}

    def distance(a, b):
        return sum((x ^ y).bit_count() for x, y in zip(a[5], b[5]))

    def can(a, b):
        return a[0] == b[0] and a[4] != b[4] and 100 * min(a[1], b[1]) >= 75 * max(a[1], b[1]) and 175 * distance(a, b) <= 25 * (a[1] + b[1])

    assert set(got) == {(a[0], a[2]) for a in rows if any(can(a, b) for b in rows)}
    named = {(r[0], r[2]): r for r in rows}
    for key, near in got.items():
        if near is not None:
            a = named[key]
            assert can(a, named[key[0], near]) and distance(a, named[key[0], near]) == min(distance(a, b) for b in rows if can(a, b))


def test_components_of_long_lists(spark, monkeypatch):
    from test_jaccard import brute

    monkeypatch.setattr(jaccard, "LONG_LIST", 8)
    rnd = random.Random(4)
    shared = [f"s{i}" for i in range(9)]
    rows = []
    for i in range(60):
        words = shared + [f"w{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 5))]
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 64)
    monkeypatch.setattr(jaccard, "VISITORS", 2)
    got = jaccard.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
