"""Stable keys: fingerprints, event ids, buckets, and content hashes that ignore row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def job_id(url: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", url, key), 256), 1, 32)


def event_id(source: Column, external: Column, job: Column, kind: str = "new-job") -> Column:
    return fingerprint(source, external, job, F.lit(kind))


def fnv_bucket(text: Column, buckets: int) -> Column:
    """32-bit FNV-1a of the text's UTF-16 units, modulo ``buckets``."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h % buckets


def content_hash(*parts: Column) -> list[Column]:
    """Aggregates that tell the multiset of rows: sums of four 32-bit words of each row's SHA-256.

    Sums merge on the map side, so no group is ever collected or sorted.
    """
    digest = fingerprint(*parts)
    return [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")).alias(f"hash_{k}") for k in range(4)]
