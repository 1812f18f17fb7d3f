"""Pieces of packed documents against the tokenizers library: cut, start, length, checksum and places."""

import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm import packing, tokens

DOCS = "doc_id long, text string, piece int, sequence_id string"
ROWS = [(0, None), (1, ""), (2, "Hello, world! é\n\n x"), (3, "word " * 64), (3, "word " * 64), (None, "no id"), (None, None), (4, "many different words, " * 300), (5, "x" * 4000), (6, "tail")] + [(10 + i, "some text here " * (i % 9)) for i in range(40)]


def test_pieces_equal_the_library(spark):
    path, most = public_tokenizers.path("byte_bpe_50k.json"), 64
    library = Tokenizer.from_file(path)
    want = Counter()
    for key, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % most or most  # only the first piece may be shorter
        cuts = [0, *range(first, len(ids) + 1, most)] if len(ids) > most else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    got = packing.pack_documents(spark.createDataFrame([(*r, 7, "s") for r in ROWS], DOCS), path, 0, most).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    assert len(places) <= -(-sum(r["length"] for r in got) // most) + 1


def test_texts_of_odd_white_space_are_told_by_fixed_strings():
    pattern = re.compile(r"[^\S \n]|[ \n][ \n]")
    for text in [*map(chr, range(0x10000)), "", "a b\nc", "a  b", "a \nb", "a\n b", "a\n\nb", "é b", "中 b", "a b"]:
        assert tokens.odd(text) == bool(pattern.search(text))
