"""WARC archives with an index written first-hand: offset, length, URL and digest of every record.

Writing: payloads of at least ``min_bytes`` bytes are grouped by digest; the largest page id of a
group is its response, the others are revisits of it. Each task writes archives of its own, one
gzip member a record, and returns an index row for each record. Reading goes by the index: the
selected records of an archive are sorted by offset, neighbouring byte ranges are coalesced into
one read, and each record is parsed from its own range.

A null page is an empty payload; pages without a URL get an empty one. Repeated rows of a page id
stay apart: all rows that bear a group's largest id are responses. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.llm.common import documents, materialize, new_path, open_input, open_output

INDEX = StructType([StructField("page_id", LongType()), StructField("archive", StringType()), StructField("offset", LongType()), StructField("length", LongType()), StructField("url", StringType()), StructField("digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType())])
RECORD = StructType([StructField("page_id", LongType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("url", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("named_digest", StringType())])
#: Size after which a task opens a further archive, and the gap that one read may bridge.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of records that a reading task takes.
TASK_BYTES = 64 << 20


def _name(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit carries no payload, only its digest and the response's id."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {'message/http' if revisit else 'text/html'}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head.append(f"Content-Length: {0 if revisit else len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_responses(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages as (page_id, url, html, digest, copy, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), body.alias("html"), F.sha1(body).alias("digest"), (F.octet_length(body) >= min_bytes).alias("large"))
    # Groups of one are no groups: only digests seen twice or more are joined, and the sum of a digest's rows
    # is made before the shuffle, so a payload that a third of the pages share costs a row a task.
    groups = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("g_digest"), "last")
    joined = rows.join(groups, F.col("large") & (F.col("digest") == F.col("g_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write all pages as records and return the index, a written table."""

    def run(batches):
        out, path, at, rows = None, "", 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = open_output(path)
                url = "".join(url.split())  # a header is one line
                data = _gzip(record_bytes(page_id, url, html.encode(), digest, refers_to))
                out.write(data)
                rows.append({"page_id": page_id, "archive": path, "offset": at, "length": len(data), "url": url, "digest": digest, "record_type": "response" if refers_to is None else "revisit", "refers_to": refers_to})
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(f.name, pa.int64() if f.dataType == LongType() else pa.string()) for f in INDEX])
    return materialize(with_responses(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")[0]


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name, payloads digested as they are read.

    Index rows are dealt by archive and stretches of ``TASK_BYTES``, to as many tasks as their bytes
    ask for; reads of neighbouring ranges are coalesced.
    """
    schema = pa.schema([(f.name, pa.int64() if f.dataType == LongType() else pa.string()) for f in RECORD])

    def run(batches):
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)))
            out, i = [], 0
            while i < len(rows):
                j, (archive, begin, length) = i + 1, rows[i]
                end = begin + length
                while j < len(rows) and rows[j][0] == archive and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - begin <= READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                with open_input(archive) as f:
                    block = memoryview(f.read_at(end - begin, begin))
                for _, offset, size in rows[i:j]:
                    fields, payload = parse_record(zlib.decompress(block[offset - begin : offset - begin + size], 31))
                    page, of = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To")
                    out.append({"page_id": None if page == "None" else int(page), "record_type": fields["WARC-Type"], "refers_to": int(of[10:-1]) if of else None, "url": fields["WARC-Target-URI"], "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "named_digest": fields["WARC-Payload-Digest"][5:]})
                i = j
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    chosen = index.select("archive", "offset", "length")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = max(1, min(TASK_BYTES, total // tasks))
    dealt = chosen.repartition(tasks, F.col("archive"), F.floor(F.col("offset") / F.lit(stretch)))
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payload size and digest of a revisit taken from the response it names."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")).dropDuplicates(["refers_to", "of_digest"])
    same = (F.col("refers_to") == F.col("of_id")) & (F.col("named_digest") == F.col("of_digest"))
    revisits = records.where("record_type = 'revisit'").join(responses.withColumnRenamed("refers_to", "of_id"), same, "left")
    resolved = revisits.select("page_id", "record_type", "refers_to", "url", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"))
    return records.where("record_type = 'response'").drop("named_digest").unionByName(resolved)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(documents(spark, sf_dir, "pages"), new_path(spark, "warc"))
    records, _ = materialize(read_records(index), "warc-records")
    return with_payloads(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
q as (select page_id, octet_length(b) n, sha1(b) d from p)
select page_id, n::bigint payload_bytes, d payload_digest,
  case when n >= 1000 and page_id < max(page_id) over (partition by d) then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id < max(page_id) over (partition by d) then max(page_id) over (partition by d) end refers_to
from q
"""
