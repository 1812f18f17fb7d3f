"""Byte-pair encoding and decoding by a pair occurrence index.

The new distinct pieces of a partition's texts, ``GROUP_CHARS`` characters of text at a time, are laid
out as one linked list of symbols; pieces merged before keep their ids. An index
maps every pair that some merge covers to all its positions. Active ranks are taken in ascending
order; each merges all its positions at once and files the pairs that arise under their ranks.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Repeated and
very long texts are ordinary input, and an empty table gives an empty table. Other columns pass
through unless they bear the name of a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gleaner.llm.common import distinct, documents, ranges, text_or_empty, trimmed
from gleaner.llm.tokens import ChunkEncoder

#: The pattern that splits text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands between pieces; no merge has it.
GAP = 0xFFFF
#: Positions that are entered in the pair index at a time at first.
FILED = 1 << 19


def byte_names() -> dict[str, int]:
    """The vocabulary's printable character of each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBpe:
    """A vocabulary file's merges, with encoding of pieces and decoding of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, names = model["model"]["vocab"], byte_names()
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 16 | right).astype(np.uint32)
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_of]
        self.first = np.zeros(256, np.int64)
        for name, b in names.items():
            self.first[b] = vocab[name]
        spelled = {i: bytes(names[c] for c in t) for t, i in vocab.items() if t not in added}
        spelled |= {i: t.encode() for t, i in added.items()}
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(table), np.uint8)
        self.special = added
        if model["model"]["type"] != "BPE" or max(spelled) >= GAP or model["pre_tokenizer"].get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no byte-level vocabulary of at most {GAP} ids without a prefix space")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(PIECES)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge covers it."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank_of[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids of all pieces one after the other."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum()) + len(pieces) + 1
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        sym = np.full(n, GAP, np.uint32)
        inside = np.ones(n, bool)
        inside[0] = inside[begins + sizes] = False
        sym[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            ranks = self.ranks(sym[at] << np.uint32(16) | sym[after[at]])
            some = ranks >= 0
            ranks, at = ranks[some], at[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            ends = np.append(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, len(ranks))
            begin = 0
            for end in ends.tolist():
                rank = int(ranks[begin])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(at[begin:end])
                begin = end

        for i in range(0, n - 1, FILED):
            file(np.arange(i, min(i + FILED, n - 1), dtype=np.int32))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # of a run's overlapping pairs, every other one from its left end
                linked = np.append(False, after[at[:-1]] == at[1:])
                run_start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = self.merged[rank], GAP
            after[at], before[beyond] = beyond, at
            file(distinct(np.concatenate([before[at], at])))
        keep = np.flatnonzero(sym != GAP)
        return np.diff(np.searchsorted(keep, np.append(begins, n))), sym[keep].astype(np.uint32)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of text: special tokens stand for themselves, the rest is cut into pieces."""
        pieces: dict[bytes, int] = {}
        flat: list[int] = []  # numbers of pieces; -1 - id for a special token
        counts = []
        number = pieces.setdefault
        for chunk in chunks:
            if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():  # one piece: a space, if any, and letters
                flat.append(number(chunk.encode(), len(pieces)))
                counts.append(1)
            else:
                before = len(flat)
                done = 0
                for m in self.cut.finditer(chunk) if self.cut and "<" in chunk else ():
                    flat += [pieces.setdefault(x.encode(), len(pieces)) for x in self.pieces.findall(chunk[done : m.start()])]
                    flat.append(-1 - self.special[m[0]])
                    done = m.end()
                flat += [pieces.setdefault(x.encode(), len(pieces)) for x in self.pieces.findall(chunk[done:] if done else chunk)]
                counts.append(len(flat) - before)
        lengths, values = self.encode_pieces(list(pieces))
        at = np.array(flat, np.int64)
        special = -1 - at[at < 0]
        at[at < 0] = len(lengths) + np.arange(len(special))
        lengths = np.append(lengths, np.ones(len(special), np.int64))
        values = np.append(values, special.astype(np.uint32))
        starts = np.cumsum(lengths) - lengths
        ends = np.append(0, np.cumsum(lengths[at]))[np.cumsum([0, *counts])]
        return np.diff(ends), values[ranges(starts[at], lengths[at])]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.spelling[ranges(self.starts[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


#: Characters of text whose new pieces are merged together.
GROUP_CHARS = 4_000_000
#: Distinct chunks of text whose ids a task keeps.
CHUNKS = 600_000


@lru_cache(maxsize=2)
def worker_encoder(path: str, chunks: int = CHUNKS) -> tuple[PairIndexBpe, ChunkEncoder]:
    bpe = PairIndexBpe(path)
    return bpe, ChunkEncoder(bpe.encode_chunks, spaced=True, held=0, cached=chunks)


def _with(df: DataFrame, text: str, names: list[str]) -> tuple[DataFrame, StructType]:
    kept = df.drop(*names)
    return kept, StructType([*kept.schema.fields])


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text in column ``ids`` (array of int)."""
    kept, schema = _with(df, text, [ids] if ids != text else [])
    schema = StructType([*schema.fields, StructField(ids, ArrayType(IntegerType(), False))])
    at = kept.columns.index(text)

    def run(batches):
        _, encoder = worker_encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = list(encoder.encode(texts, GROUP_CHARS))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], names=schema.names)
        encoder.shrink()

    return kept.mapInArrow(trimmed(run), schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of every list of ids in column ``text``; a null list gives an empty text."""
    kept, schema = _with(df, text, [text])
    schema = StructType([*schema.fields, StructField(text, StringType())])
    at = kept.columns.index(ids)

    def run(batches):
        bpe, _ = worker_encoder(path)
        for batch in batches:
            lists = batch.column(at)
            out = [bpe.decode(np.array(x.values if x.is_valid else [], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return kept.mapInArrow(trimmed(run), schema)


def bpe_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text within its task and return the digests of both.

    The ids and the decoded text are the same as :func:`bpe_encode` and :func:`bpe_decode` give;
    they stay within the task, as only their SHA-256 is asked for.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(batches):
        bpe, encoder = worker_encoder(path)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for ids in encoder.encode(batch.column(1).to_pylist(), GROUP_CHARS):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=schema.names)
        encoder.shrink()

    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(trimmed(run), schema)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
