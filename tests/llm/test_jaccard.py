"""Near copies against all pairs."""

import random
import re

import pytest

from gleaner.llm.jaccard import near_copy_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    """Groups of copies, chains of edits and passages that documents with little else share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passages = [[word() for _ in range(30)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, "x" * 200_000)]
    for _ in range(40):
        base = [word() for _ in range(rnd.randrange(5, 80))]
        for _ in range(rnd.randrange(1, 8)):
            rows.append((len(rows), " ".join(base)))
            base[rnd.randrange(len(base))] = word()
    for _ in range(60):
        rows.append((len(rows), " ".join(sum(rnd.sample(passages, 3), []) + [word() for _ in range(4)])))
    got = near_copy_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("block", [1 << 22, 2000])
def test_one_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies that are edited so much that many link only through others, and some with none."""
    from gleaner.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard, "VISITORS", 5)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(60)] = f"x{rnd.randrange(2000)}"
        rows.append((i, " ".join(words)))
    got = near_copy_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert 10 < len({c for _, c in want.values()}) < 140


def test_empty_table_and_other_names(spark):
    assert near_copy_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 7), (1, "a b c d e f", 8), (None, "a b c d e f", 9)], "doc_id long, text string, node long")
    assert sorted((r["component_id"] for r in near_copy_components(odd).collect()), key=str) == [1, 1, 1]
