"""Removal of byte strings that occur twice, by suffix order over anchored segments.

Texts are UTF-8 bytes. Every window of ``least`` bytes has an anchor, the first of the
``GRAM``-byte strings within it that have the smallest hash, so equal windows have equal anchors. A
text falls into segments, runs of windows with one anchor; segments are dealt by anchor, and only anchors that occur twice
matter. Equal segments go as one with a count. What is left, strings of all different segments, is
indexed by a Burrows-Wheeler transform, and threshold-bounded interval expansion finds the windows
that share ``least`` bytes or more with another (see :mod:`gleaner.llm.bwt`). Consecutive segments
of a text that are alone with their copies under their anchors go as one string.

A passage shorter than ``least`` in very many texts gives one anchor a different segment in each.
Such hot anchors are split before any task holds them: their segments fall into segments of a longer
anchor, equal ones of which merge and lone ones leave, and those whose anchor is hot again go on to
a longer one, at last to single windows. So the strings of an anchor that are indexed together are
at most ``HOT_BYTES``.

The found windows return to every occurrence of their segment, and a text loses the union of its
windows. Matches never cross texts; all strings are judged on the input. A null text is empty;
repeated rows repeat all their bytes; texts shorter than ``least`` lose nothing. Empty tables give no
rows. Rows of the same key with different texts are kept apart.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.llm.bwt import repeated_starts
from gleaner.llm.common import dealt, documents, materialize, text_or_empty, trimmed

#: Bytes of an anchor, of texts that are hashed together, and of strings that are indexed together.
GRAM, GROUP_BYTES, INDEX_BYTES = 160, 1_000_000, 1_000_000
#: Bytes of one anchor's different segments from which on they are split by longer anchors.
HOT_BYTES = 2_000_000
SEGMENT = "hash long, content long, doc_key long, text_hash long, start int, windows int"
STRING = "anchor long, bytes binary, pieces array<struct<hash:long,content:long,windows:int,times:long>>"
FOUND = "hash long, content long, begins array<int>, ends array<int>"
PART = "part_hash long, part_content long, hash long, content long, first int, windows int, times long"
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Segments of byte strings by the smallest hash within each window."""

    def __init__(self, least: int, seed: int = 0, gram: int = GRAM):
        self.least, self.gram = least, min(gram, least)
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)

    def segments(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor, content hash, string number, start in the string and windows of each segment."""
        n, least, width = len(data), self.least, self.least - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < least:
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none
        room = 1 << max(21, n.bit_length())
        up, down = _powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * up[:n], out=sums[1:])
        h = _mixed((sums[self.gram :] - sums[: -self.gram]) * down[: n - self.gram + 1])
        windows = len(h) - width + 1
        # The place takes the low bits, so of equal hashes the first is the anchor.
        places = np.uint64((1 << max(21, n.bit_length())) - 1)
        placed = (h & ~places) | np.arange(len(h), dtype=np.uint64)
        blocks = np.concatenate([placed, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        anchor = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        inside = owner[:windows] == owner[least - 1 : least - 1 + windows]
        border = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:windows] != owner[: windows - 1]) | (inside[1:] != inside[:-1])))
        ends = np.append(border[1:], windows)
        keep = inside[border]
        start, end = border[keep], ends[keep]
        count = end - start
        content = _mixed((sums[end + least - 1] - sums[start]) * down[start]) ^ count.astype(np.uint64) * np.uint64(_BASE)
        return h[anchor[start] & places], content, owner[start].astype(np.int64), start - begins[owner[start]], count


def _segments(batches, least: int):
    anchors = Anchors(least)
    names = ["hash", "content", "doc_key", "text_hash", "start", "windows"]
    for batch in batches:
        keys, hashes = (batch.column(i).to_numpy() for i in (0, 1))
        texts = [x.encode() for x in batch.column(2).to_pylist()]
        sizes = np.array([len(x) for x in texts], np.int64)
        group = np.cumsum(sizes) // GROUP_BYTES
        for g in np.unique(group):
            rows = np.flatnonzero((group == g) & (sizes >= least))
            if not len(rows):
                continue
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            anchor, content, owner, start, count = anchors.segments(data, sizes[rows])
            at = rows[owner]
            cols = [anchor.view(np.int64), content.view(np.int64), keys[at], hashes[at], start.astype(np.int32), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _strings(batches, least: int):
    """Strings to index, cut from texts by their lists of segments; lone neighbours go together."""
    for batch in batches:
        anchors, data, pieces = [], [], []
        for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, end = text.encode(), None
            for row in sorted(rows, key=lambda x: x["start"]):
                piece = {k: row[k] for k in ("hash", "content", "windows", "times")}
                after = row["start"] + row["windows"]
                if row["lone"] and end == row["start"] and after - data[-1][0] < INDEX_BYTES:
                    pieces[-1].append(piece)
                    data[-1] = (data[-1][0], after + least - 1)
                else:
                    anchors.append(row["hash"])
                    data.append((row["start"], after + least - 1))
                    pieces.append([piece])
                end = after if row["lone"] else None
            data = [text[x[0] : x[1]] if isinstance(x, tuple) else x for x in data]
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(data, pa.binary()), pa.array(pieces, pa.list_(pa.struct([("hash", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("times", pa.int64())])))], names=["anchor", "bytes", "pieces"])


def _index(batches, least: int):
    """Index strings, whole anchors together, and give each piece's runs of repeated windows."""
    held, seen, size, last = [], set(), 0, None

    def found(rows):
        strings = [np.frombuffer(x, np.uint8) for x, _ in rows]
        many = repeated_starts(strings, np.array([min(p["times"] for p in pieces) for _, pieces in rows]), least)
        out = []
        for flags, (_, pieces) in zip(many, rows):
            at = 0
            for p in pieces:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags[at : at + p["windows"]].astype(np.int8), [0]])))
                if len(edges):
                    out.append({"hash": p["hash"], "content": p["content"], "begins": edges[::2].tolist(), "ends": edges[1::2].tolist()})
                at += p["windows"]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("hash", pa.int64()), ("content", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))

    for batch in batches:
        for anchor, data, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= INDEX_BYTES and anchor != last:
                yield found(held)
                held, seen, size = [], set(), 0
            last, name = anchor, (anchor, pieces[0]["content"], len(data))
            if name not in seen:  # rows of one key and text send their strings more than once
                seen.add(name)
                held.append((data, pieces))
                size += len(data)
    if held:
        yield found(held)


def _indexed(strings: DataFrame, least: int) -> DataFrame:
    found = dealt(strings, "anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(lambda b: _index(b, least)), FOUND)
    return materialize(found, "repeated")[0]


def _parts(batches, least: int, gram: int):
    """Segments of segments, by anchors of ``gram`` bytes."""
    anchors = Anchors(least, gram, gram)
    names = ["part_hash", "part_content", "hash", "content", "first", "windows", "times"]
    for batch in batches:
        hashes, contents, times = (batch.column(i).to_numpy() for i in range(3))
        data = batch.column(3).to_pylist()
        sizes = np.array([len(x) for x in data], np.int64)
        group = np.cumsum(sizes) // GROUP_BYTES
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            anchor, content, owner, start, count = anchors.segments(np.frombuffer(b"".join(data[i] for i in at), np.uint8), sizes[at])
            of = at[owner]
            # Equal windows have equal anchors before as well, so both name the new one.
            name = _mixed(anchor ^ hashes[of].view(np.uint64) * np.uint64(_BASE))
            cols = [name.view(np.int64), content.view(np.int64), hashes[of], contents[of], start.astype(np.int32), count.astype(np.int32), times[of].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _split(segments: DataFrame, least: int, width: int) -> DataFrame:
    """FOUND of ``segments`` (hash, content, times, bytes) of hot anchors, by anchors that are the first
    of ``width`` strings within a window. With a width of 1 a window is its own anchor, so none is hot."""
    parts = segments.mapInArrow(trimmed(lambda b: _parts(b, least, least - width + 1)), PART)
    # A part that is alone under its anchor and stands once repeats nothing.
    many, _ = materialize(parts.groupBy("part_hash").agg(F.sum("times").alias("n")).where("n > 1").select("part_hash"), "anchors")
    places, _ = materialize(parts.join(many, "part_hash"), "places")
    groups, _ = materialize(places.groupBy("part_hash", "part_content").agg(F.sum("times").alias("times"), F.min(F.struct("hash", "content", "first", "windows")).alias("at")).select("at.*", "part_hash", "part_content", "times"), "segments")
    hot, _ = materialize(_hot(groups.select(F.col("part_hash").alias("hash"), "windows"), least), "hot")
    whole = segments.select("hash", "content", "bytes")

    def cut(chosen: DataFrame) -> DataFrame:
        named = chosen.select("hash", "content", "first", "windows", "part_hash", "part_content", "times").join(whole, ["hash", "content"])
        return named.select(F.col("part_hash").alias("hash"), F.col("part_content").alias("content"), "times", F.expr(f"substring(bytes, first + 1, windows + {least - 1})").alias("bytes"), "windows")

    again = hot.withColumnRenamed("hash", "part_hash")
    cold = cut(groups.join(again, "part_hash", "left_anti") if width > 1 else groups)
    found = _indexed(cold.select(F.col("hash").alias("anchor"), "bytes", F.array(F.struct("hash", "content", "windows", "times")).alias("pieces")), least)
    if width > 1 and hot.limit(1).count():
        more, _ = materialize(cut(groups.join(again, "part_hash", "left_semi")).drop("windows"), "hot-segments")
        found = found.unionByName(_split(more, least, max(1, width // 4)))
    found = found.select(F.col("hash").alias("part_hash"), F.col("content").alias("part_content"), "begins", "ends")
    shifted = places.select("hash", "content", "first", "part_hash", "part_content").join(found, ["part_hash", "part_content"])
    return materialize(shifted.select("hash", "content", F.expr("transform(begins, x -> x + first)").alias("begins"), F.expr("transform(ends, x -> x + first)").alias("ends")), "repeated")[0]


def _hot(segments: DataFrame, least: int) -> DataFrame:
    """The anchors (hash) whose different segments are too many for one task."""
    return segments.groupBy("hash").agg(F.sum(F.col("windows") + F.lit(least - 1)).alias("n_bytes")).where(F.col("n_bytes") > HOT_BYTES).select("hash")


def repeated_windows(df: DataFrame, least: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_key, text_hash, spans): runs of repeated windows of every text that has some."""
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc_key"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).alias("text"))
    segments = rows.mapInArrow(trimmed(lambda b: _segments(b, least)), SEGMENT)
    # Counts merge before the shuffle and the join splits large keys, so an anchor that very many
    # texts share is no hot task; copies of a segment are one row from the first count on.
    many, _ = materialize(segments.groupBy("hash").count().where("count > 1").select("hash"), "anchors")
    places, _ = materialize(segments.join(many, "hash"), "places")
    groups, _ = materialize(places.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_key", "text_hash", "start", "windows")).alias("first")), "segments")
    kinds = groups.groupBy("hash").agg((F.count(F.lit(1)) == 1).alias("lone"))
    firsts = groups.join(kinds, "hash").select("first.*", "hash", "content", "times", "lone")
    hot, _ = materialize(_hot(groups.select("hash", "first.windows"), least), "hot")
    some = hot.limit(1).count() > 0

    def strings(chosen: DataFrame) -> DataFrame:
        needed = chosen.groupBy("doc_key", "text_hash").agg(F.collect_list(F.struct("start", "windows", "hash", "content", "times", "lone")).alias("segments"))
        return rows.join(needed, ["doc_key", "text_hash"]).select("text", "segments").mapInArrow(trimmed(lambda b: _strings(b, least)), STRING)

    found = _indexed(strings(firsts.join(hot, "hash", "left_anti") if some else firsts), least)
    if some:
        hot_strings = strings(firsts.join(hot, "hash", "left_semi")).select(F.col("pieces")[0].alias("piece"), "bytes")
        hot_segments = hot_strings.select("piece.hash", "piece.content", "piece.times", "bytes").groupBy("hash", "content").agg(F.first("times").alias("times"), F.first("bytes").alias("bytes"))
        hot_segments, _ = materialize(hot_segments, "hot-segments")
        found = found.unionByName(_split(hot_segments, least, max(1, (least - min(GRAM, least) + 1) // 4)))
    spans = places.select("hash", "content", "doc_key", "text_hash", "start").join(found, ["hash", "content"])
    return spans.groupBy("doc_key", "text_hash").agg(F.collect_list(F.struct("start", "begins", "ends")).alias("spans"))


def removed_mask(size: int, spans: list[dict] | None, least: int) -> np.ndarray:
    """Which bytes of a text go, from the runs of repeated windows in its segments."""
    change = np.zeros(size + 1, np.int64)
    for s in spans or ():
        for a, b in zip(s["begins"], s["ends"]):
            change[s["start"] + a] += 1
            change[s["start"] + b - 1 + least] -= 1
    return np.cumsum(change)[:size] > 0


def _kept(data: bytes, spans, least: int) -> tuple[bytes, int, int]:
    if not spans:
        return data, 0, 0
    gone = removed_mask(len(data), spans, least)
    runs = int(gone[0]) + int(np.count_nonzero(~gone[:-1] & gone[1:]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _joined(df: DataFrame, least: int, key: str, text: str) -> DataFrame:
    spans = repeated_windows(df, least, key, text).select(F.col("doc_key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    on = (F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) == F.col("_key")) & (F.xxhash64(text_or_empty(text)) == F.col("_hash"))
    return df.join(spans, on, "left")


def remove_repeats(df: DataFrame, least: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every repeated string of ``least`` bytes gone from its text.

    Where a cut falls within a character, the rest of the character goes as well.
    """
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else _kept(t.encode(), s, least)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            cols = [*batch.columns[: len(names)]]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = df.columns
    return _joined(df, least, key, text).select(*names, "_spans").mapInArrow(trimmed(run), df.schema)


def repeat_digests(df: DataFrame, least: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, bytes, removed bytes, maximal removed runs and SHA-256 of what stays."""
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                kept, n, runs = _kept(data, spans, least)
                rows.append((len(data), n, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=schema.names)

    return _joined(df, least, key, text).select(F.col(key), text_or_empty(text).alias("text"), "_spans").mapInArrow(trimmed(run), schema)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir).select("doc_id", "text"))
