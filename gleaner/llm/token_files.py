"""Flat files of token ids with 64-bit document offsets, written and read in ascending key order.

Every range of keys becomes two files:

* ``.ids``: the ids of all its documents, unsigned, little-endian, nothing else;
* ``.idx``: 40 bytes (the magic ``GLTOKEN2``, then as little-endian 64-bit integers the bytes an id
  takes, 2 or 4, the number of documents, those without a key, and the number of ids), then the
  documents' keys (int64) and documents + 1 offsets (int64, in ids, from 0).

Ids go to their file as they are made; a task keeps the key and offset of each document. A manifest
names the files of each part with their counts and their base, the number of ids in all parts before
it: bases are prefix sums over the manifest, which has a row a part. Tasks write under names of
their own attempt, so a task that runs again leaves no half file in the manifest.

A null text is empty and has the end id alone. Documents without a key come first; equal keys stand
in no fixed order among themselves. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.llm.common import documents, materialize, new_path, open_input, open_output, text_or_empty
from gleaner.llm.tokens import library_encoder

MAGIC = b"GLTOKEN2"
MANIFEST = StructType([StructField("part", LongType()), StructField("path", StringType()), StructField("n_docs", LongType()), StructField("n_ids", LongType())])
#: The ids that are written or read at a time.
READ_IDS = 1 << 20


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, folder: str, spaced: bool = False, id_bytes: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files and return the manifest with bases."""
    kind = np.dtype(f"<u{id_bytes}")
    most = (1 << 8 * id_bytes) - 1
    if not 0 <= end_id <= most:
        raise ValueError(f"id {end_id} takes more than {id_bytes} bytes")

    def write(out, parts: list[np.ndarray]) -> None:
        ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
        if len(ids) and int(ids.max()) > most:
            raise ValueError(f"an id takes more than {id_bytes} bytes")
        out.write(ids.astype(kind).tobytes())

    def run(batches):
        encoder, end = library_encoder(vocabulary, spaced), np.array([end_id], np.uint32)
        keys, sizes, nulls, out = [], [], 0, None
        path = f"{folder}/{uuid.uuid4().hex}"
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or open_output(f"{path}.ids")
                nulls += batch.column(0).null_count
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                ready, held = [], 0
                for x in encoder.encode(batch.column(1).to_pylist()):
                    ready += [x, end]
                    held += len(x) + 1
                    sizes.append(len(x) + 1)
                    if held >= READ_IDS:
                        write(out, ready)
                        ready, held = [], 0
                write(out, ready)
        finally:
            if out is not None:
                out.close()
        if not sizes:
            return
        from pyspark import TaskContext

        offsets = np.append(0, np.cumsum(np.array(sizes, "<i8"))).astype("<i8")
        with open_output(f"{path}.idx") as f:
            f.write(MAGIC + struct.pack("<4q", id_bytes, len(sizes), nulls, int(offsets[-1])))
            for x in (*keys, offsets):
                f.write(x.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": path, "n_docs": len(sizes), "n_ids": int(offsets[-1])}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = df.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    written = rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, MANIFEST)
    manifest, _ = materialize(written, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_file(path: str):
    """Keys (an Arrow array), offsets and an array-like of ids of one part; local files are mapped, not read."""
    index, flat = open_input(f"{path}.idx"), open_input(f"{path}.ids")
    head = index.read_at(40, 0)
    magic, (id_bytes, n_docs, nulls, n_ids) = bytes(head[:8]), struct.unpack("<4q", head[8:40])
    if magic != MAGIC or flat.size() != id_bytes * n_ids:
        raise ValueError(f"{path} is no whole token file")
    keys = np.frombuffer(index.read_at(8 * n_docs, 40), "<i8")
    offsets = np.frombuffer(index.read_at(8 * (n_docs + 1), 40 + 8 * n_docs), "<i8")

    def ids(i: int, j: int) -> np.ndarray:
        return np.frombuffer(flat.read_at(id_bytes * (j - i), id_bytes * i), f"<u{id_bytes}")

    return pa.array(keys, mask=np.arange(n_docs) < nulls), offsets, ids


def read_token_digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the files of a manifest back: for each document its place, size and CRC-32 of its ids."""
    schema = StructType([StructField(x, LongType()) for x in (key, "start", "n_tokens", "ids_crc32")])

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, offsets, ids = read_token_file(path)
                crcs = np.zeros(len(keys), np.int64)
                i = 0
                while i < len(keys):  # a stretch of documents of about READ_IDS at a time
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_IDS, "right")) - 1)
                    block, at = ids(int(offsets[i]), int(offsets[j])).astype("<u4"), offsets[i : j + 1] - offsets[i]
                    crcs[i:j] = [zlib.crc32(block[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    i = j
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crcs)], names=schema.names)

    return manifest.select("path", "base").repartition("path").mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, new_path(spark, "tokens"))
    return read_token_digests(manifest)
