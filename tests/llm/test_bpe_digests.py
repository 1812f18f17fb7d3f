"""The registered path of op2 against the library."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.bpe import bpe_digests

TEXTS = [(0, None), (1, ""), (2, "Hello, world! <|endoftext|> 12 é\n\n x"), (3, "a" * 30_000), (None, "no id"), (4, "  \t two  spaces "), (4, "  \t two  spaces ")]


def test_digests_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)

    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = bpe_digests(spark.createDataFrame(TEXTS, "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*x) for x in TEXTS), key=str)
