"""Archives of pages with nulls, repeated ids, shared and empty payloads, and columns of clashing names."""

import hashlib
from collections import Counter

from gleaner.llm import warc

PAGES = "page_id long, url string, html string, digest string, record_type int, refers_to string"


def test_every_page_comes_back_with_its_payload(spark, tmp_path):
    shared, other = "<p>é" * 400, "<i>x" * 300
    rows = [(5, "u5", shared), (5, "u5", shared), (3, None, shared), (None, "n", shared), (None, None, "short"), (7, "u7", None), (8, "", ""), (9, "u 9é", other), (9, "u9", other + "!"), (1, "u1", other), (2, "u2", "short"), (4, "u4", "short")]
    pages = spark.createDataFrame([(*r, "d", 1, "x") for r in rows], PAGES)
    got = warc.with_payloads(warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/w"))).collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((t or "").encode()), digest(t)) for i, _, t in rows)
    largest = {digest(shared): 5, digest(other): 9, digest(other + "!"): 9}
    for r in got:
        if r["record_type"] == "revisit":
            assert r["refers_to"] == largest[r["payload_digest"]] != r["page_id"]
        else:
            assert r["refers_to"] is None
    kinds = {(r["page_id"], r["payload_digest"]): r["record_type"] for r in got}
    assert kinds[3, digest(shared)] == kinds[1, digest(other)] == "revisit"
    assert {kinds[5, digest(shared)], kinds[9, digest(other)], kinds[2, digest("short")], kinds[4, digest("short")], kinds[8, digest("")]} == {"response"}


def test_no_pages(spark, tmp_path):
    assert warc.with_payloads(warc.read_records(warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w"))).count() == 0
