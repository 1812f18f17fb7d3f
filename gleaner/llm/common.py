"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


#: Tables written and not removed yet.
_written: list[str] = []


def _libc():
    lib = ctypes.CDLL(None)
    return lib if hasattr(lib, "malloc_trim") else None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only in a local session where that is unset a
    temporary folder is made and kept for the session.
    """
    own = "gleaner.shared.dir"
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(own, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set(own, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _written.append(path)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def clear(spark: SparkSession, *kept: str) -> None:
    """Delete all tables that this process wrote in the shared folder but ``kept``.

    To be called when results are written, as they read such tables.
    """
    remove(spark, *(path for path in _written if path not in kept))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    _written[:] = [path for path in _written if path not in paths]
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for another file system."""
    if re.match(r"file:", uri):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_output(uri: str):
    """A binary sink for a task's own file, on any file system that Arrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + os.path.abspath(uri))
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A random-access file: memory-mapped where it is local, ranged reads elsewhere."""
    import pyarrow as pa
    from pyarrow import fs

    own = local_path(uri)
    if own:
        return pa.memory_map(own, "r")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def trim() -> None:
    """Give freed memory back to the system; a worker that stays keeps little between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (lib := _libc()) is not None:
        lib.malloc_trim(0)


#: Rows of texts that a worker turns into strings at a time.
TEXT_ROWS = 2000


def trimmed(run, rows: int | None = None):
    """A function of batches whose worker gives memory back after every batch and at its end.

    With ``rows`` it gets batches of at most so many.
    """

    def parts(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    def wrapped(batches):
        try:
            for out in run(parts(batches) if rows else batches):
                yield out
                del out
                trim()
        finally:
            trim()

    return wrapped


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` over all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending (by a sort, which numpy vectorises)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in as many partitions as the session's shuffles have: for tasks whose work is far
    more than their bytes, which Spark would otherwise put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Bits of a filter of names, of fixed size whatever the input: more names only let more pass.
FILTER_BITS = 24


def filter_words(names: DataFrame) -> DataFrame:
    """(word, bits): a bit filter of the 64-bit column ``name``, in at most ``2**(FILTER_BITS - 6)`` rows."""
    bit = F.col("name").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = names.select(F.shiftright(bit, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_hits(df: DataFrame, name, words: DataFrame, column: str = "_hit") -> DataFrame:
    """``df`` with whether the filter has ``name``: true for all names in it, and for few others. A broadcast of bounded size."""
    bit = name.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    marked = df.withColumn("_bit", bit)
    joined = marked.join(F.broadcast(words.toDF("_word", "_bits")), F.shiftright("_bit", 6).cast("int") == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.coalesce("_bits", F.lit(0)), F.col("_bit").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(column, hit).drop("_bit", "_word", "_bits")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
