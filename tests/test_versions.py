"""Conditional writes and the texts of alerts, with expected values written out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import messages, versions

SCHEMA = "user string, id int, state string, n int"


@pytest.fixture
def table(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "user", "id")
    t.upsert(spark.createDataFrame([("u", 1, "a", 1), ("u", 2, None, 2), ("v", 1, "c", 3)], SCHEMA))
    return t


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def test_upsert_insert_delete(spark, table):
    table.upsert(spark.createDataFrame([("u", 1, "b", 9), ("w", 1, "d", 4)], SCHEMA))
    assert rows(table) == [("u", 1, "b", 9), ("u", 2, None, 2), ("v", 1, "c", 3), ("w", 1, "d", 4)]
    for bad in ([("v", 1, "x", 0), ("x", 1, "x", 0)], [("x", 1, "x", 0), ("x", 1, "y", 0)]):
        with pytest.raises(versions.Conflict):
            table.insert(spark.createDataFrame(bad, SCHEMA))
    assert table.version() == 2
    table.insert(spark.createDataFrame([("x", 1, "x", 0)], SCHEMA))
    table.delete(spark.createDataFrame([("u",)], "user string"), "user")
    assert rows(table) == [("v", 1, "c", 3), ("w", 1, "d", 4), ("x", 1, "x", 0)]
    assert len(table.read(1).collect()) == 3  # earlier versions stay readable


def test_a_lost_race_changes_nothing(spark, table):
    read = table.version()
    first, second = table.read(read).withColumn("n", F.lit(1)), table.read(read).withColumn("n", F.lit(2))
    table.commit(first, read)
    with pytest.raises(versions.Conflict):
        table.commit(second, read)
    assert {r[3] for r in rows(table)} == {1} and table.version() == read + 1


def test_updates_ask_for_what_was_seen(spark, table):
    changes = spark.createDataFrame([("u", 1, "new", "a", 1), ("u", 2, "new", None, 2), ("v", 1, "new", "c", 99), ("z", 1, "new", "c", 3)], "user string, id int, state string, seen_state string, seen_n int")
    done = {(r["user"], r["id"]): r["applied"] for r in table.update(changes, ["state", "n"]).collect()}
    assert done == {("u", 1): True, ("u", 2): True, ("v", 1): False, ("z", 1): False}
    assert rows(table) == [("u", 1, "new", 1), ("u", 2, "new", 2), ("v", 1, "c", 3)]
    assert not any(r["applied"] for r in table.update(changes, ["state", "n"]).collect())  # again: all have moved on


def test_repairs_ask_for_their_dry_run(spark, table):
    wrong, fix = F.coalesce(F.col("n") < 3, F.lit(False)), {"state": F.lit("fixed"), "n": F.lit(3)}
    count, token = table.dry_run(wrong, ["state", "n"])
    assert count == 2 and table.dry_run(wrong, ["state", "n"]) == (count, token)
    for bad in ((1, token), (count, "other")):
        with pytest.raises(versions.Conflict):
            table.repair(wrong, fix, ["state", "n"], *bad)
    table.upsert(spark.createDataFrame([("u", 2, "moved", 2)], SCHEMA))
    with pytest.raises(versions.Conflict):
        table.repair(wrong, fix, ["state", "n"], count, token)
    table.repair(wrong, fix, ["state", "n"], *table.dry_run(wrong, ["state", "n"]))
    assert rows(table) == [("u", 1, "fixed", 3), ("u", 2, "fixed", 3), ("v", 1, "c", 3)] and table.dry_run(wrong, ["state", "n"])[0] == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, want", [("Software Engineering Intern", "SWE"), ("Machine Learning Internship", "ML"), ("Cloud Infrastructure Software Engineering Intern", "SWE"), ("Compiler Intern – ", "Compiler"), ("Intern", "Intern"), ("Data\tScience  co-op", "DS"), (None, ""), ("Software Development Engineer", "SDE")])
def test_short_titles(spark, title, want):
    assert one(spark, messages.compact_title(F.lit(title).cast("string"))) == want


def test_templates_and_escapes(spark):
    assert one(spark, messages.render("{a} · {b}\n{c}\n\nSource: {a}", {"a": F.lit("x{b}"), "b": F.lit(None).cast("string"), "c": F.lit(" ")})) == "x{b} · \nSource: x{b}"
    assert one(spark, messages.escape_html(F.lit("<a href='x'>&</a>"))) == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"
    assert one(spark, messages.safe_diagnostic(F.lit("failed https://x.com/y?z now " + "a" * 600))) == "failed [url] now " + "a" * 483
    assert one(spark, messages.safe_link(F.lit("https://x.com"))) == "https://x.com" and one(spark, messages.safe_link(F.lit("javascript:1"))) is None


def test_chunks_cut_before_the_limit(spark):
    df = spark.createDataFrame([("d", k, k, "x" * n) for k, n in enumerate((8, 8, 9, 50, 1))] + [("e", 0, 9, "")], "device string, nth int, job int, body string")
    got = sorted(map(tuple, messages.summary_chunks(df, "device", "nth", "job", "body", 20).collect()))
    assert got == [("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("d", 3, 2), ("d", 4, 3), ("e", 9, 0)]
