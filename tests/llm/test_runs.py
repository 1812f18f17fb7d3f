"""Runs against the definition, tried at every place and period."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from gleaner.llm import runs

DOCS = "doc_id long, text string, n_words int, runs string, _key int"


def brute(words, least=6, times=4):
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in found)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 3), max_size=12).map(lambda x: x * 5), st.lists(st.integers(0, 9), max_size=30)), min_size=1, max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_classes_show_every_run(texts, limits):
    cuts = np.append(0, np.cumsum([len(x) for x in texts]))
    got = list(zip(*(x.tolist() for x in runs.runs_of(np.array([w for x in texts for w in x], np.int64), cuts, *limits))))
    want = [(int(cuts[k]) + s, n, q) for k, x in enumerate(texts) for s, n, q in brute(x, *limits)]
    assert got == want


def rows():
    said = [(0, None), (1, ""), (2, " \n\t "), (3, "a b " * 9), (4, "x" + " y" * 7 + " z" + " y" * 5), (None, "p q r " * 4 + "s"), (3, "a b " * 9), (5, "one two three"), (6, "ab\x0bcd\x1cef " * 6), (7, "w " * 30_000)]
    return [(i, t, 1, "r", 2) for i, t in said] + [(100 + k, " ".join(f"w{(k * j * j) % (5 + k)}" for j in range(k * 3)), 1, "r", 2) for k in range(60)]


def test_texts_and_odd_input(spark):
    df = spark.createDataFrame(rows(), DOCS)
    got = sorted((str((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in runs.find_runs(df).collect()))
    want = []
    for i, text, *_ in rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append(str((i, len(words), found, collapsed(words, found))))
    assert got == sorted(want)
    assert runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_query_plants_finds_and_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op13_periodic_runs(spark, sf_dir).collect()}
    planted = 0
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        if n > 1500:
            continue
        found = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        want += (hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest())
        assert got[i] == want
    assert planted > 5 and len(got) == len(docs)
