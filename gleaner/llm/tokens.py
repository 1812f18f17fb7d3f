"""Token ids of whole texts, with one library call per distinct chunk of text.

A text is cut where no token of the vocabulary can cross, each distinct chunk is encoded once
for each worker, and a text's ids are gathered from the chunks'. The cuts are exact:

* byte-level BPE: before a space that stands between two characters other than white space,
  and around a line feed between such characters;
* word BPE: at spaces and line feeds, as the vocabulary drops white space.

Texts with other white space take the slower cut by regular expression.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.common import ranges

#: White space that the fast cut does not cover: any other character of it, or two of these in a row.
_ODD = ["  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Distinct chunks that a worker keeps; beyond that it starts anew.
CACHED_CHUNKS = 1_000_000
#: Distinct chunks that a worker keeps from one task to the next.
HELD_CHUNKS = 500_000
#: Chunks of text whose ids are put together at a time.
GATHERED = 1 << 19


def odd(text: str) -> bool:
    """Whether the text needs the slower cut; searches of fixed strings take far less than a pattern."""
    return any(map(text.__contains__, _ODD))


class ChunkEncoder:
    """Ids of texts by a function that gives the sizes and the joined ids of a list of chunks."""

    def __init__(self, encode_chunks, spaced: bool, held: int = HELD_CHUNKS, cached: int = CACHED_CHUNKS):
        self.encode_chunks, self.spaced, self.held, self.cached = encode_chunks, spaced, held, cached
        self._reset()

    def _reset(self) -> None:
        encoder = self
        self.pending: list[str] = []

        class Index(dict):
            def __missing__(self, key):
                n = self[key] = len(self)
                encoder.pending.append(key)
                return n

        self.index = Index()
        self.values = np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def _marked(self, text: str) -> str:
        """The text with its keys between spaces: the word after a space, or CR and a chunk."""
        return "\r" + text.replace("\n", " \n \r") if self.spaced else text.replace("\n", " ")

    def _chunk(self, key: str) -> str:
        if not self.spaced or key == "\n":
            return key
        return key[1:] if key[:1] == "\r" else " " + key

    def _core(self, key: str) -> str:
        """The key of the chunk without its last character where that is surely a token of its own.

        So is a comma or full stop after a letter or digit. A vocabulary that drops white space
        also lowers A-Z and composes characters; below U+0250 only U+0130 changes its kind by that.
        """
        before = key[-2:-1]
        core = key[:-1] if key[-1:] in (",", ".") and before.isalnum() and (self.spaced or before < "\u0250" and before != "\u0130") else key
        if not self.spaced and not core.islower() and core.isascii() and core.isalnum():
            core = core.lower()
        return core

    def _learn(self) -> None:
        if not self.pending:
            return
        new, first = self.pending, len(self.starts)
        plain, joined, pairs, of_core = [], [], [], self._core
        for i, key in enumerate(new, first):  # a core that is new comes to the end of the list
            if self.spaced and not key.endswith((",", ".")):  # it is its own core
                plain.append(i)
                continue
            core = of_core(key)
            if core == key:
                plain.append(i)
            else:
                joined.append(i)
                mark = key[-1] if len(core) < len(key) else ""
                pairs.append((self.index[core], self.index["\r" + mark if self.spaced else mark]))
        self.pending = []
        self.starts, self.lengths = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.starts, self.lengths))
        self._append(plain, *self.encode_chunks([self._chunk(new[i - first]) for i in plain]))
        if joined:
            two = np.array(pairs)
            self._append(joined, self.lengths[two].sum(1), self.values[ranges(self.starts[two].ravel(), self.lengths[two].ravel())])

    def _append(self, at: list[int], lengths: np.ndarray, values: np.ndarray) -> None:
        self.starts[at] = len(self.values) + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.values = np.concatenate([self.values, values])

    def shrink(self) -> None:
        """Start anew if more than ``held`` chunks are known; called at the end of a task."""
        if len(self.index) > self.held:
            self._reset()

    def encode(self, texts: list[str], group_chars: int = 4_000_000):
        """An array of uint32 ids for each text, in groups of about ``group_chars``."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= group_chars:
                yield from self._group(group)
                group, chars = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]):
        if len(self.index) > self.cached:
            self._reset()
        odds = {i: ["\r" + x for x in _CUT.split(t)] for i, t in enumerate(texts) if odd(t)} if self.spaced else {}
        plain = ["" if i in odds else self._marked(t) for i, t in enumerate(texts)]
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        # Arrow finds the group's distinct chunks, so the cache is asked once for each of them.
        seen = split.flatten().dictionary_encode()
        look_up = self.index.__getitem__
        known = np.fromiter(map(look_up, seen.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(seen.dictionary))
        odds = {i: np.fromiter(map(look_up, keys), np.int64, len(keys)) for i, keys in odds.items()}
        self._learn()
        indices, cuts = seen.indices.to_numpy(), split.offsets.to_numpy()
        del split, seen, plain
        i = 0
        while i < len(texts):  # ids are put together for a stretch of texts at a time
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + GATHERED, "right")) - 1)
            chunks = known[indices[cuts[i] : cuts[j]]]
            sizes = self.lengths[chunks]
            values = self.values[ranges(self.starts[chunks], sizes)]
            ends = np.append(0, np.cumsum(sizes))[cuts[i : j + 1] - cuts[i]].tolist()
            for k in range(i, j):
                if k in odds:
                    yield self.values[ranges(self.starts[odds[k]], self.lengths[odds[k]])]
                else:
                    yield values[ends[k - i] : ends[k - i + 1]]
            i = j
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The encoder of a vocabulary file, one for each worker; special tokens are recognised."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()

    def encode_chunks(chunks: list[str], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        lengths: list[int] = []
        values: list[int] = []
        for i in range(0, len(chunks), step):
            for x in library.encode_batch(chunks[i : i + step], add_special_tokens=False):
                ids = x.ids
                lengths.append(len(ids))
                values += ids
        return np.array(lengths, np.int64), np.array(values, np.uint32)

    return ChunkEncoder(encode_chunks, spaced)
