"""Runs of words that repeat with a period, by refinement of classes of equal factors.

Positions of a text fall into classes by their factor of a length, first of one word. Classes of
length l + 1 come from those of length l: two positions stay together while their successors do.
Of the parts of a split class the largest is not looked at again, as the others tell it apart, so
every position is moved a logarithmic number of times. Each class is a linked list in text order. A
link that is as long as the factors it stands for at some time is a square whose root is no power,
and squares of one period at neighbouring places are one run.

Whole batches of texts are refined together in numpy: a word of one text is never that of another.
Words are what white space parts (the six ASCII spaces). A null text has no words and no runs, and
its collapsed text is empty. Rows are taken as they are: nulls and repeats in the key do not matter.
Texts of any length are taken whole, each by one task. An empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleaner.llm.common import TEXT_ROWS, documents, ranges, trimmed

#: Characters of text that are refined together, unless one text is longer.
GROUP_CHARS = 6_000_000
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class _Classes:
    """Classes of positions as linked lists in text order, and the squares that their links have shown."""

    def __init__(self, names: np.ndarray, cuts: np.ndarray, most_period: np.ndarray):
        n = len(names)
        order = np.argsort(names, kind="stable")
        new = np.append(True, names[order[1:]] != names[order[:-1]])[:n]
        self.of = np.empty(n, np.int32)
        self.of[order] = np.cumsum(new) - 1
        self.made = int(new.sum())
        self.size = np.zeros(n + 1, np.int32)
        self.size[: self.made] = np.diff(np.append(np.flatnonzero(new), n))
        self.next, self.last = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        joined = np.flatnonzero(~new)
        self.next[order[joined - 1]] = order[joined]
        self.last[order[joined]] = order[joined - 1]
        self.born = np.ones(n, np.int32)
        self.moving = np.zeros(n, bool)
        self.first = np.zeros(n, bool)
        self.first[cuts[:-1][np.diff(cuts) > 0]] = True
        #: The longest period that matters in a position's text.
        self.most = np.repeat(most_period, np.diff(cuts)).astype(np.int32)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _show(self, i: np.ndarray, gap: np.ndarray, length) -> None:
        """The links from ``i`` end, which stood for factors of up to ``length`` words."""
        square = (self.born[i] <= gap) & (gap <= length)
        if square.any():
            self.squares.append((i[square], gap[square]))

    def _members(self, at: np.ndarray) -> np.ndarray:
        """All positions of the classes that the positions ``at`` are in, each class once."""
        found, ahead, back = [at], self.next[at], self.last[at]
        for step, link in ((ahead, self.next), (back, self.last)):
            while len(step := step[step >= 0]):
                found.append(step)
                step = link[step]
        return np.concatenate(found)

    def refine(self, before: np.ndarray, by: np.ndarray, length: int) -> np.ndarray:
        """Split the classes of ``length`` words: positions ``before`` those of the classes ``by`` leave the others.

        Returns the positions of all new parts but the largest of each split class.
        """
        live = self.size[self.of[before]] > 1
        live &= self.most[before] > length
        before, by = before[live], by[live]
        if not len(before):
            return before
        own = self.of[before]
        order = np.lexsort((before, by, own))
        before, by, own = before[order], by[order], own[order]
        head = np.append(True, (own[1:] != own[:-1]) | (by[1:] != by[:-1]))
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(own)))
        parent = own[starts]
        family = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        members = np.diff(np.append(family, len(parent)))
        rest = self.size[parent[family]] - np.add.reduceat(sizes, family)
        largest = np.maximum.reduceat(sizes, family)
        # The largest part keeps the class where nothing else is left of it; else what is left keeps it.
        is_largest = sizes == np.repeat(largest, members)
        nth = np.cumsum(is_largest)
        is_largest &= nth - np.repeat(nth[family] - is_largest[family], members) == 1
        whole = np.repeat(rest == 0, members)
        moved = ~(is_largest & whole)
        if not moved.any():
            return before[:0]
        stays_small = rest < largest
        small = ~(is_largest & np.repeat(stays_small, members))

        taken = np.repeat(moved, sizes)
        inner, group = before[taken], np.repeat(np.cumsum(moved) - 1, sizes)[taken]
        self._unlink(inner, length)
        self._link(inner, group, length)
        n = int(moved.sum())
        self.of[inner] = self.made + group
        self.size[self.made : self.made + n] = sizes[moved]
        np.subtract.at(self.size, parent[moved], sizes[moved].astype(np.int32))
        self.made += n

        out = [before[np.repeat(small & moved, sizes)]]
        left = (rest > 0) & stays_small
        if left.any():
            out.append(self._members(self.beside[np.searchsorted(self.of[self.beside], parent[family][left])]))
        return np.concatenate(out)

    def _unlink(self, inner: np.ndarray, length: int) -> None:
        """Take positions out of their lists. Neighbours in a list that leave together are one stretch."""
        self.moving[inner] = True
        at = np.sort(inner) if len(inner) < 2 else inner[np.lexsort((inner, self.of[inner]))]
        last, following = self.last[at], self.next[at]
        begins = (last < 0) | ~self.moving[last]
        ends = (following < 0) | ~self.moving[following]
        a, b, cut = last[begins], following[ends], at[begins]
        self.moving[inner] = False
        held = a >= 0
        self._show(a[held], cut[held] - a[held], length)
        self.next[a[held]] = b[held]
        self.born[a[held]] = length + 1
        open_ = b >= 0
        self.last[b[open_]] = a[open_]
        # One position beside each class that lost some, by class.
        beside = np.where(held, a, b)
        beside = beside[beside >= 0]
        named, first = np.unique(self.of[beside], return_index=True)
        self.beside = beside[first]

    def _link(self, inner: np.ndarray, group: np.ndarray, length: int) -> None:
        """Lists of the new classes; links between positions that left together live on."""
        same = group[1:] == group[:-1]
        following, last = np.full(len(inner), -1, np.int32), np.full(len(inner), -1, np.int32)
        following[:-1][same] = inner[1:][same]
        last[1:][same] = inner[:-1][same]
        old = self.next[inner]
        changed = old != following
        ended = changed & (old >= 0)
        self._show(inner[ended], old[ended] - inner[ended], length)
        self.next[inner], self.last[inner] = following, last
        self.born[inner[changed]] = length + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """All squares as (place, period)."""
        i = np.flatnonzero(self.next >= 0)
        self._show(i, self.next[i] - i, self.most[i])
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*self.squares))


def runs_of(words: np.ndarray, cuts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` periods, by start and period.

    ``words`` holds the word numbers of all texts, ``cuts`` where texts begin and end.
    """
    n = len(words)
    counts = np.diff(cuts)
    text = np.repeat(np.arange(len(counts)), counts)
    classes = _Classes(text * (int(words.max(initial=0)) + 1) + words, cuts, counts // times)
    # After the last word of a text comes something that is nowhere else.
    ends = cuts[1:][counts > 0] - 1
    small = np.arange(n)
    length = 1
    while len(small):
        follows = small[~classes.first[small]]
        before, by = follows - 1, classes.of[follows]
        if length == 1:
            before, by = np.append(before, ends), np.append(by, n + np.arange(len(ends)))
        small = classes.refine(before, by, length)
        length += 1
    place, period = classes.finish()
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))[: len(place)])
    start, q = place[new], period[new]
    long = np.diff(np.append(new, len(place))) - 1 + 2 * q
    kept = long >= np.maximum(least, times * q)
    start, long, q = start[kept], long[kept], q[kept]
    order = np.lexsort((q, start))
    return start[order], long[order], q[order]


def _texts(texts: pa.Array, least: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words = split.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    cuts = np.append(0, np.cumsum(real))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    words = words.filter(pa.array(real))
    start, length, period = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), cuts, least, times)

    where = np.searchsorted(cuts, start, side="right") - 1
    offsets = np.searchsorted(where, np.arange(len(cuts)))
    fields = [start - cuts[where], length, period]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"]))
    kept = np.ones(len(words), bool)
    kept[ranges(start + period, length - period)] = False
    left = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[cuts], pa.int64()), words.filter(pa.array(kept)))
    return pa.array(np.diff(cuts), pa.int64()), runs, pc.binary_join(left, pa.scalar(" ", pa.large_string()))


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """A row for each row of ``df``: key, n_words, runs and collapsed.

    ``runs`` are (start, length, period) of all stretches of at least ``least`` words and ``times``
    times their smallest period that no neighbouring word extends, by start, then period; word
    numbers count from 0. ``collapsed`` is the words that no run holds after its first period,
    joined by one space.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            begin = chars = 0
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for i, size in enumerate(sizes):
                chars += size
                if chars >= GROUP_CHARS or i == len(sizes) - 1:
                    part = batch.slice(begin, i + 1 - begin)
                    n, runs, left = _texts(part.column(1), least, times)
                    yield pa.RecordBatch.from_arrays([part.column(0), n, runs, left.cast(pa.string())], ["_key", "n_words", "runs", "collapsed"])
                    begin, chars = i + 1, 0

    schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(trimmed(run, TEXT_ROWS), schema).withColumnRenamed("_key", key)


def with_planted_period(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where the text of every tenth key by its hash repeats from some word on.

    With h the CRC-32 of the key and g = h / 10, of n words those from a = g % n on repeat with period
    1 + (n - a) / (3 + g % 8). Rows without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.call_function("floor", h / 10).cast("long")
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select(key, F.col(text).alias("_text"), g.alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    n, a, p = F.size("_words").cast("long"), F.col("_a"), F.col("_p")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.call_function("floor", (n - a) / (3 + F.col("_g") % 8)).cast("long"))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", place(i))), " ")
    return rows.select(key, F.when(a.isNotNull(), again).otherwise(F.col("_text")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest run of every text (ties: smallest start, then period) and digests of all its runs and of what is left."""
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("_best")
    long: Column = best["length"]
    return found.withColumn("_best", ranked).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        long.alias("length"),
        (-best["period"]).alias("period"),
        F.call_function("floor", 1000 * long / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(with_planted_period(documents(spark, sf_dir))))
