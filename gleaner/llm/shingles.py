"""Sets of word shingles as 64-bit hashes, made in numpy for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gleaner.llm.common import distinct

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters of text that are hashed together.
GROUP_CHARS = 2_000_000


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and where each text's begin and end.

    Words end at the six ASCII spaces. Arrow finds the distinct words, so each is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()).fill_null("")))
    words = split.flatten()
    seen = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, seen.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(seen.dictionary))
    real = np.append(0, np.cumsum(pc.binary_length(words).to_numpy() > 0))  # white space at an end leaves an empty word
    codes = seen.indices.to_numpy()
    return table[codes[np.diff(real) > 0]], real[split.offsets.to_numpy()]


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = (x ^ (x >> np.uint64(29))) * _MULTIPLIER + h[k : k + len(x)]
    return _finished(x)


def shingle_sets(texts: list[str | None], size: int = 5):
    """For each text its distinct shingles of ``size`` words, ascending; a shorter text is one shingle."""
    begin = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= GROUP_CHARS or i == len(texts) - 1:
            h, cuts = word_hashes(texts[begin : i + 1])
            rolled = _rolled(h, size) if len(h) >= size else h[:0]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= size:
                    yield distinct(rolled[a : b - size + 1])
                else:
                    yield _rolled(h[a:b], b - a) if b > a else h[:0]
            begin, chars = i + 1, 0


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
