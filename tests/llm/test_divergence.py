"""Distances of sources against plain arithmetic and the query's SQL."""

import re
from collections import Counter, defaultdict

import pytest
from oracle import assert_same

from gleaner.llm import divergence

DOCS = "text string, lang string, source string, n int, term string"


def expected(rows, least=3, most=200, scale=10**9):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = {s: counts[lang, s] for x, s in groups if x == lang}
        every[None] = sum(every.values(), Counter())
        p = {s: {t: 1 + scale * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for s, c in every.items()}
        far = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // p[b][t]
        for s in every:
            if s is None:
                continue
            found = {"pair": [(sum(far(s, o, t) for t in kept), o) for o in every if o is not None and o != s], "term": [(far(s, None, t), t) for t in kept if every[s][t] and p[s][t] > p[None][t]]}
            for part, values in found.items():
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < most]
    return sorted(out)


ROWS = [("The cat, the DOG and the cat", "en", "a"), ("the dog's cat Éa éa", "en", "b"), (None, "en", "c"), ("the cat\x00éa zz9zz", None, None), ("", None, "a"), ("x y", "fr", "a"), ("x y", "fr", "b"), ("the " * 500, "en", "b"), ("cat dog éa zz", "en", "a"), ("zz zz", "en", "d"), ("zz", "en", "d"), ("123 --", "de", "q")]
ROWS += [(f"w{'abcdefgh'[i % 8]} common v{'abc'[i % 3]}{'xy'[i % 2]} " * (1 + i % 5), "en", "abcde"[i * i % 5]) for i in range(80)]


@pytest.mark.parametrize("each", [1, 250_000])
def test_equals_plain_arithmetic_in_any_shards(spark, monkeypatch, each):
    monkeypatch.setattr(divergence, "SHARD_COUNTS", each)
    got = divergence.source_divergence(spark.createDataFrame([(*r, 1, "t") for r in ROWS], DOCS)).collect()
    assert sorted(tuple(r) for r in got) == expected(ROWS)


def test_few_terms_by_rank_ties_and_empty_table(spark):
    df = spark.createDataFrame([(*r, 1, "t") for r in ROWS + ROWS], DOCS)
    assert sorted(tuple(r) for r in divergence.source_divergence(df, most_terms=2).collect()) == expected(ROWS + ROWS, most=2)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert_same(divergence.op11_source_divergence(spark, sf_dir), divergence.OP11_SQL, sf_dir)
