"""Best-fit packing of token sequences by a configuration linear program.

Ids come from the pair-index encoder, which gives the library's ids for a third of its time.
A document's ids end with one end id; a document longer than a sequence is cut into full pieces
and one shorter first piece. Only the histogram of piece lengths, at most one number a length,
reaches the driver. There a covering program over configurations (multisets of lengths that fit)
is solved by multiplicative weights: each round prices the lengths by their unmet demand and a
knapsack dynamic program finds the configuration of most price. The fractional solution is rounded
down, what is left over is placed by best fit, and pieces take the places of their length by rank.

A null text is empty and has the end id alone; repeated rows are separate pieces; an empty table
gives no rows. Ranks are prefix sums of counts by task, so a length with many pieces is no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gleaner.llm.bpe import CHUNKS, GROUP_CHARS, worker_encoder
from gleaner.llm.common import documents, materialize, text_or_empty, trimmed

#: Rounds of multiplicative weights; the fractional solution is the mean of their configurations.
ROUNDS = 160
#: Width of the blocks that ranks are dealt in, so that no join key is hot.
BLOCK = 4096


def best_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
    """How often each length stands in the fullest-priced configuration (bounded knapsack).

    Lengths are taken in binary-split bundles (1, 2, 4, ... up to ``most``); the table has a row a
    bundle and a column a capacity.
    """
    bundles = [(k, n) for k in range(len(lengths)) for n in _bundles(int(min(most[k], size // lengths[k])))]
    value, took = np.zeros(size + 1), np.zeros((len(bundles), size + 1), bool)
    for row, (k, n) in enumerate(bundles):
        weight = int(n * lengths[k])
        other = value[: size + 1 - weight] + n * prices[k]
        took[row, weight:] = other > value[weight:] + 1e-12
        value[weight:] = np.maximum(value[weight:], other)
    used, room = np.zeros(len(lengths), np.int64), size
    for row in range(len(bundles) - 1, -1, -1):
        if took[row, room]:
            k, n = bundles[row]
            used[k] += n
            room -= int(n * lengths[k])
    return used


def _bundles(n: int) -> list[int]:
    out, step = [], 1
    while n > 0:
        out.append(min(step, n))
        n -= out[-1]
        step *= 2
    return out


def solve_configurations(histogram: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """Sequences as (how many, {length: copies}) that together hold exactly the histogram."""
    out = [(n, {size: 1}) for length, n in histogram.items() if length == size and n]
    left = Counter({k: n for k, n in histogram.items() if 0 < k < size and n})
    if left:
        lengths = np.array(sorted(left, reverse=True))
        demand = np.array([left[k] for k in lengths.tolist()], float)
        bound = demand @ lengths / size
        weights, found = lengths / size, Counter()
        for _ in range(rounds):
            use = best_configuration(lengths, weights, np.maximum(1, np.ceil(demand / bound * 8)), size)
            found[tuple(use.tolist())] += 1
            covered = use * bound / demand  # by how much one round's share covers each length
            weights = weights * np.exp(-0.5 * (covered - 1) / max(1.0, covered.max()))
            weights /= weights.max()
        total = sum(found.values())
        for use, n in found.most_common():
            items = {int(lengths[k]): c for k, c in enumerate(use) if c}
            times = min([int(bound * n / total), *(left[k] // c for k, c in items.items())])
            if items and times:
                out.append((times, items))
                left.subtract({k: c * times for k, c in items.items()})
        out += best_fit({k: n for k, n in left.items() if n}, size)
    return out


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest lengths first, over counts: equal fillings stay together as one entry."""
    open_: dict[int, list[list]] = {}  # room -> [how many, items]
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = size // length
                whole, rest = divmod(n, each)
                for times, copies in ((whole, each), (int(rest > 0), rest)):
                    if times:
                        open_.setdefault(size - copies * length, []).append([times, {length: copies}])
                break
            times, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // length, n)
            here = min(times, n // each)
            if here < times:
                open_.setdefault(room, []).append([times - here, items])
            open_.setdefault(room - each * length, []).append([here, items | {length: items.get(length, 0) + each}])
            n -= here * each
    return [(times, items) for entries in open_.values() for times, items in entries]


def cut_pieces(df: DataFrame, vocabulary: str, end_id: int, size: int, key: str = "doc_id", text: str = "text", chunks: int = CHUNKS, group_chars: int = GROUP_CHARS, rows: int | None = None) -> DataFrame:
    """A row for each piece: key, piece, start, length, CRC-32 of its ids, and its rank among the
    pieces of its length that its task made (task, task_rank).

    ``chunks``, ``group_chars`` and ``rows`` (of a batch) bound what a worker holds, at some cost in
    time; the result does not depend on them.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("piece", IntegerType()), *(StructField(x, LongType()) for x in ("start", "length", "ids_crc32", "task", "task_rank"))])

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        _, encoder = worker_encoder(vocabulary, chunks)
        for batch in batches:
            owners, rest = [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist(), group_chars)):
                data = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = (len(data) - 1) % size + 1
                for piece, start in enumerate([0, *range(first, len(data), size)]):
                    length = first if piece == 0 else size
                    owners.append(row)
                    rest.append((piece, start, length, zlib.crc32(data[start : start + length]), task, int(seen[length])))
                    seen[length] += 1
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(x, k) for x, k in zip(list(zip(*rest)) or [()] * 6, [pa.int32()] + [pa.int64()] * 5))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        encoder.shrink()

    return df.select(F.col(key), text_or_empty(text).alias("text")).mapInArrow(trimmed(run, rows), schema)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (written rows of :func:`cut_pieces`) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row a length
    places, first = [], 0
    ranked: Counter = Counter()
    for times, items in solve_configurations(histogram, size):
        at = 0
        for length, copies in sorted(items.items(), reverse=True):
            places.append((length, ranked[length], copies, times, first, at))
            ranked[length] += copies * times
            at += copies * length
        first += times
    # Rank r of a length lies in the one run of places with first_rank <= r; runs are few (configurations
    # times their lengths), and each is found by the blocks of ranks that it touches.
    runs = spark.createDataFrame(places, "length long, first_rank long, copies long, times long, first_sequence long, first_offset long")
    runs = runs.withColumn("block", F.explode(F.sequence(F.expr(f"first_rank div {BLOCK}"), F.expr(f"(first_rank + copies * times - 1) div {BLOCK}"))))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranks = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    placed = ranks.join(runs, ["length", "block"]).where("rank >= first_rank and rank < first_rank + copies * times")
    nth = F.col("rank") - F.col("first_rank")
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div copies")).withColumn("offset", F.col("first_offset") + (nth % F.col("copies")) * F.col("length")).drop("block", "first_rank", "copies", "times", "first_sequence", "first_offset", "base", "rank", "task", "task_rank")


def pack_documents(df: DataFrame, vocabulary: str, end_id: int, size: int = 2048, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """Pack all whole texts into sequences of at most ``size`` ids: a row for each piece.

    ``bounds`` are those of :func:`cut_pieces`.
    """
    pieces, _ = materialize(cut_pieces(df, vocabulary, end_id, size, key, text, **bounds), "pieces")
    packed = pack(pieces, size)
    return packed.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)
