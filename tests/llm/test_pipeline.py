"""Stages of the pipeline on small tables."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=""):
    more = (7,) if extra else ()
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *more) for i, t in rows], DOCS + extra)


def some_texts():
    rnd = random.Random(8)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(n))

    base, passage = words(80).split(), words(70)
    copies = [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in (3, 40, 70)]
    rows = [(i, t) for i, t in enumerate([None, "", "short", *copies, words(60) + " mail a.b@c.org or +1 (504) 555-2652", words(30) + passage, passage + words(30), words(3000)], 10)]
    return rows + [rows[3], (None, "no id"), (None, None)]


def test_stages_on_small_tables(spark, sf_dir):
    """Near copies, passages and personal data against plain rules, with nulls, equal rows, and a further column."""
    rows = some_texts()
    docs = table(spark, rows, ", spans int")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(i, t) for i, t in dict.fromkeys(rows) if i not in (14, 15)]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = corpus_pipeline.cut_repeats(spark, kept, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    passage = [t for i, t in rows if i == 17][0]
    assert len(texts[17]) < len(passage) - 400 and len(texts[19]) == len(dict(rows)[19]) and texts[10] is None and texts[11] == ""
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_personal_data(spark, cut, sf_dir).collect()}
    assert masked[16].endswith("mail [EMAIL] or [PHONE]") and masked[10] is None
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.pack_sequences(spark, cut, sf_dir).collect()
    sizes = {}
    for r in pieces:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert all(sizes[i] == len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items() if i is not None)


def test_toxic_documents_go(spark, tmp_path):
    from gleaner.llm.toxicity import learnable
    from pyspark.sql import functions as F

    clean = [f"the {a} sat on the {b} near a {c}" for a in ("cat", "dog", "crow") for b in ("mat", "roof", "wall", "bench") for c in ("tree", "house", "river", "garden")]
    texts = clean + [f"{x} you grumblefink" for x in clean[:24]]
    docs = table(spark, [*enumerate(texts), (900, None), (901, ""), (902, "so long grumble-fink")])
    spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(texts))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert docs.where(learnable("doc_id")).count() < docs.count()
    got = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert got == {*range(len(clean)), 900, 901}
    assert docs.where(F.lit(False)).columns == corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, sf_dir, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, []), sf_dir).count() == 0


def test_cut_repeats_keeps_texts_that_were_empty(spark):
    rnd = random.Random(5)
    passage, own = ("".join(rnd.choice("abcdefgh ") for _ in range(500)) for _ in range(2))
    texts = [None, "", "", "short", passage, passage, own + passage]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {0: (None, None), 1: ("", 0), 2: ("", 0), 3: ("short", 5), 6: (own, 500)}
