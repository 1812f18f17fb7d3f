"""Training samples and very long runs of one-letter words."""

import pytest

from gleaner.llm import toxicity


def test_absent_and_long_texts_take_no_place_in_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, rate: taken.append((texts, labels)))
    long = "x" * (toxicity.LONGEST + 1)
    docs = spark.createDataFrame([(i, long if i >= 100 else f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    toxicity.train_on(docs, labels)
    (texts, got), = taken
    assert sorted(got) == [0] * 10 + [1] * 10 and len(set(texts)) == 20 and max(map(len, texts)) < 10


@pytest.mark.parametrize("n", [100, (1 << 20) + 5000])
def test_runs_of_one_letter_words_are_spelled_whole(n):
    words, _, _ = toxicity.words_of(["a " * n + "b u g"])
    assert max(words.to_pylist(), key=len) == "a" * n + "bug"
