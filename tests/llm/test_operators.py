"""Small tables against brute force and round trips, with nulls, empty texts, ties and repeated rows."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing, pii, repeats, token_files, topk, toxicity, warc
from gleaner.llm.bpe import bpe_decode, bpe_encode

TEXTS = [(0, None), (1, ""), (2, "Hello, world! <|endoftext|> 12 é\n\n x"), (3, "Hello, world! <|endoftext|> 12 é\n\n x"), (4, "a" * 30_000), (None, "no id"), (5, "  \t two  spaces ")]
DOCS = "doc_id long, text string"


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe_decode(bpe_encode(spark.createDataFrame(TEXTS, DOCS), path), path).collect():
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([x for x in TEXTS if x[0] is not None], DOCS)
    got = token_files.read_token_digests(token_files.write_token_files(docs, path, 2, f"file://{tmp_path}/t")).collect()
    start = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(x for x in TEXTS if x[0] is not None)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)


def test_packing(spark):
    rows = packing.pack_documents(spark.createDataFrame(TEXTS, DOCS), public_tokenizers.path("byte_bpe_50k.json"), 0, 512).collect()
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(filled) <= -(-sum(r["length"] for r in rows) // 512) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), 0).count() == 0


def test_repeats(spark):
    k, passage = 40, "This passage of more than forty bytes stands in several texts."
    rows = [(0, None), (1, ""), (2, "short"), (3, passage + " one"), (4, "two é " + passage), (5, "three " * 40), (6, "unlike all of the rest, really, in every way there is"), (7, passage + " one")]
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(d[j : j + k] for d in data.values() for j in range(len(d) - k + 1))
    for r in repeats.repeat_digests(spark.createDataFrame(rows, DOCS).repartition(3), k).collect():
        d = data[r["doc_id"]]
        gone = {x for j in range(len(d) - k + 1) if seen[d[j : j + k]] > 1 for x in range(j, j + k)}
        assert r["n_removed"] == len(gone) and r["kept_sha256"] == hashlib.sha256(bytes(c for j, c in enumerate(d) if j not in gone)).hexdigest()


def test_top_k(spark):
    rows = [(i, [((i * 7 + j * 3) % 11) / 11 - 0.4 for j in range(6)]) for i in range(120)] + [(500, None), (501, [float("nan")] * 6), (502, [None] * 6), (None, [1.0] * 6)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 256)
    cells = {r["id"]: r["cells"] for r in vectors.collect()}
    got = {}
    for r in topk.top_k(vectors.where("id % 50 = 0"), vectors, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(cells[q], c)), i) for i, c in cells.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_broadcasts_nothing_and_merges_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    rows = [(i, [((i * 13 + j * 5) % 23) / 23 - 0.4 for j in range(4 + i % 3)]) for i in range(150)] + [(0, [0.5] * 4), (3, []), (3, [2.0] * 9)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 256)
    found = topk.top_k(vectors.where("id % 5 = 0"), vectors, 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    cells, got = [(r["id"], r["cells"]) for r in vectors.collect()], {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 150, 5))
    for q, ranked in got.items():
        asked = min(c for i, c in cells if i == q)
        best = sorted((-sum(a * b for a, b in zip(asked, c)), i) for i, c in cells if i != q)[:5]
        assert sorted(ranked) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(vectors.where("id < 0"), vectors, 5).count() == topk.top_k(vectors, vectors.where("id < 0"), 5).count() == 0


def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a", long), (2, None, long), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "http://e", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.with_payloads(warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/w"))).collect()}
    assert got == {1: ("revisit", 2, 2003), 2: ("response", None, 2003), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0)}


def test_pii_field_finds_what_patterns_miss():
    found = 0
    table = pii.labelled_table(seed=1234)
    for text, spans in table:
        found += set(pii.find_spans([text])[0][1]) == set(spans)
    assert found >= 0.93 * len(table)


def test_pii_redacts(spark):
    rows = [(1, "write to jo@x.org or call (504) 555-2652 now", "k"), (2, None, None), (3, "", "z")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, DOCS + ", spans string")).collect()}
    assert got == {1: "write to [EMAIL] or call [PHONE] now", 2: None, 3: ""}


def test_toxicity_learns_gapped_insults(spark):
    clean = [f"the {a} sat on the {b} near a {c}" for a in ("cat", "dog", "crow") for b in ("mat", "roof", "wall", "bench") for c in ("tree", "house", "river", "garden")]
    toxic = [f"{x} you grumblefink" for x in clean[:24]]
    model = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    scores = model.scores(["you grumble-fink there", "you are a g.r.u.m.b.l.e.f.i.n.k", "the cat sat near a river", None, ""])
    assert scores[:2].min() > scores[2:].max()
    assert toxicity.train([], []).scores(["a"])[0] == 0


@pytest.mark.parametrize("name", ["op3_maxscore_top_k", "op5_ngram_jaccard", "op7_warc_index", "op9_quality_rules"])
def test_query_equals_its_sql(spark, sf_dir, name):
    from oracle import assert_same

    from gleaner.llm import queries

    assert_same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)
