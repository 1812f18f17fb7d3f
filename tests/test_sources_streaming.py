import json

from pyspark.sql import functions as F

from gleaner.sources import postings
from gleaner.streaming import presence

TABLE = """# List
| Company | Role | Location | Apply | Status |
| --- | --- | --- | --- | --- |
| **Acme** | SWE Intern | NYC | [Apply](https://a.com/1) | Open |
| ↳ | Data \\| ML Intern | Remote | <a href="https://a.com/2">Apply</a> | Closed |
| short | row |
| Beta | PM Intern | SF | no link | Open |

| Name | Value |
|---|---|
| x | y |
"""


def test_markdown_tables(spark):
    df = spark.createDataFrame([("d", TABLE), ("e", None), ("f", "")], "document string, value string")
    got = sorted((r["company"], r["title"], r["apply_url"], r["state"]) for r in postings.list_postings(df, "lists").collect())
    assert got == [("Acme", "Data | ML Intern", "https://a.com/2", "closed"), ("Acme", "SWE Intern", "https://a.com/1", "open")]


def test_boards(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"jobs": [{"id": 1, "internal_job_id": 2, "title": "T", "location": {"name": "L"}, "absolute_url": "https://x", "content": "c"}, {"id": 2, "internal_job_id": None, "title": "P"}]}))
    rows = postings.greenhouse_postings(postings.read_boards(spark, str(tmp_path / "g.json"), postings.GREENHOUSE), "g").collect()
    assert [(r["external_id"], r["state"]) for r in rows] == [("1", "open"), ("2", "prospect")]
    (tmp_path / "a.json").write_text(json.dumps({"apiVersion": "1", "jobs": [{"id": "u", "title": "T", "isListed": True}, {"id": "v", "isListed": False}]}))
    assert [r["external_id"] for r in postings.ashby_postings(postings.read_boards(spark, str(tmp_path / "a.json"), postings.ASHBY), "a").collect()] == ["u"]
    (tmp_path / "l.json").write_text(json.dumps([{"id": "z", "text": "T", "categories": {"commitment": "Internship", "allLocations": ["A", "B"]}}]))
    row = postings.lever_postings(postings.read_boards(spark, str(tmp_path / "l.json"), postings.LEVER), "l").first()
    assert (row["location"], row["authority"]) == ("A / B", "posting")


SNAPSHOT = "source_id string, number long, external_id string"


def put(spark, feed, *rows):
    spark.createDataFrame([("src", n, i) for n, i in rows], SNAPSHOT).coalesce(1).write.mode("append").json(str(feed))


def run(spark, feed, state, checkpoint):
    presence.follow(spark.readStream.schema(SNAPSHOT).json(str(feed)), str(state), str(checkpoint)).awaitTermination()
    return {r["external_id"]: (r["present"], r["omissions"], r["open"]) for r in presence.occurrences(spark, str(state)).collect()}


def test_snapshots_as_a_stream(spark, tmp_path):
    feed, seen = tmp_path / "in", []
    for n, ids in enumerate((["r", "s"], ["s"], ["s"], ["s"], ["r"])):
        put(spark, feed, *((n, i) for i in ids))
        seen.append(run(spark, feed, tmp_path / "state", tmp_path / "cp"))
    assert [x["r"] for x in seen] == [(True, 0, True), (False, 1, True), (False, 2, False), (False, 2, False), (True, 0, True)]
    assert seen[3]["s"] == (True, 0, True) and seen[4]["s"] == (False, 1, True)


def test_snapshots_of_one_batch_fold_in_order(spark, tmp_path):
    feed = tmp_path / "in"
    put(spark, feed, (1, "a"), (2, None), (3, None), (2, "b"), (1, "c"), (3, "c"))
    got = run(spark, feed, tmp_path / "state", tmp_path / "cp")
    assert got == {"a": (False, 2, False), "b": (False, 1, True), "c": (True, 0, True)}
    # An unchanged confirmation of an empty snapshot counts as one more omission.
    put(spark, feed, (4, None))
    assert run(spark, feed, tmp_path / "state", tmp_path / "cp")["b"] == (False, 2, False)


def test_a_fresh_checkpoint_changes_nothing(spark, tmp_path):
    feed = tmp_path / "in"
    put(spark, feed, (1, "a"), (1, "b"))
    put(spark, feed, (2, "b"))
    before = run(spark, feed, tmp_path / "state", tmp_path / "cp")
    assert before == {"a": (False, 1, True), "b": (True, 0, True)}
    assert run(spark, feed, tmp_path / "state", tmp_path / "other") == before
    put(spark, feed, (3, "b"))
    assert run(spark, feed, tmp_path / "state", tmp_path / "third") == {"a": (False, 2, False), "b": (True, 0, True)}
    assert len(presence._versions(spark, str(tmp_path / "state"))) <= 2


def test_outbox_sends_once(spark, tmp_path):
    schema, feed = "event_id string", tmp_path / "in"
    for ids in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(i,) for i in ids], schema).coalesce(1).write.mode("append").json(str(feed))
        presence.send_events(spark.readStream.schema(schema).json(str(feed)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    presence.send_events(spark.readStream.schema(schema).json(str(feed)), str(tmp_path / "out"), str(tmp_path / "other")).awaitTermination()
    assert sorted(r[0] for r in presence.sent_events(spark, str(tmp_path / "out"), schema).collect()) == ["a", "b", "c"]


def test_window_counts(spark, tmp_path):
    feed = tmp_path / "runs"
    spark.createDataFrame([("s", "2024-01-01 00:10:00"), ("s", "2024-01-01 00:20:00"), ("s", "2024-01-01 00:40:00")], "source_id string, ts string").write.json(str(feed))
    runs = spark.readStream.schema("source_id string, ts timestamp").json(str(feed))
    q = presence.window_counts(runs).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["runs"] for r in spark.table("w").collect()) == [1, 2]
