"""List documents: both layouts and their cases, with expected values written out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources import lists, postings

PAGE = """# Roles
| Company | Role | Location | Apply | Pay | Date |
| :--- | --- | --- | --- | --- | --- |
| **Acme** | SWE Intern | NYC | [Apply](https://a.com/1?x=1&amp;y=2) | $40 - $55/hr | Jan 5 |
| ↳ | Quant \\| ML Intern | Remote | <a href="https://apply.example.com/quant">Apply</a> | $120,000 per year | |
| Gone Co | PM Intern 🔒 | | [![Apply](https://img.example.com/b)](https://gone.example.com/2). | | |
| short | row |

<table><thead><tr><th>Company</th><th>Role</th><th>Link</th></tr></thead><tbody>
<tr><td>↳</td><td>Inherited Intern</td><td><a href="https://h.example.com/1">Apply</a> <a href="https://mirror.example.com/1">Mirror</a></td></tr>
<tr><td><strong>Beta</strong></td><td>Research Intern 🇺🇸 🎓<table><tr><th>Company</th><th>Role</th><th>Apply</th></tr><tr><td>Inner</td><td>Nested Intern</td><td>https://n.example.com/9.</td></tr></table></td><td>https://h.example.com/2</td></tr>
<tr><td>too</td><td>few</td></tr>
</tbody></table>
"""


def test_tables_of_both_kinds():
    got = [(r["company"], r["title"], r["location"], r["apply_url"], r["closed"], r["citizenship"], r["degree"]) for r in lists.table_postings(PAGE)]
    assert got == [
        ("Acme", "SWE Intern", "NYC", "https://a.com/1?x=1&y=2", False, False, False),
        ("Acme", "Quant | ML Intern", "Remote", "https://apply.example.com/quant", False, False, False),
        ("Gone Co", "PM Intern 🔒", "Unspecified", "https://gone.example.com/2", True, False, False),
        ("Gone Co", "Inherited Intern", "Unspecified", "https://h.example.com/1", False, False, False),
        ("Beta", "Research Intern 🇺🇸 🎓", "Unspecified", "https://h.example.com/2", False, True, True),
        ("Inner", "Nested Intern", "Unspecified", "https://n.example.com/9", False, False, False),
    ]
    assert [r["row"] for r in lists.table_postings(PAGE)][:3] == [4, 5, 6]


@pytest.mark.parametrize("text", ["", "| Company | Role |\n| --- | --- |\n| Acme | Intern |", "| Company | Role | Apply |\nno rule\n| Acme | Intern | https://a.com |", "| Company | Role | Apply |\n| --- | --- | --- |\n| Acme | Intern | none |", "<table><tr><td>Company</td></tr></table>", "| Company | Role | Date Posted |\n| --- | --- | --- |\n| Acme | Intern | https://a.com |"])
def test_what_is_no_list_gives_nothing(text):
    assert list(lists.table_postings(text)) == []


def test_cells():
    assert lists.split_row("| a \\| b | c\\\\ | |") == ["a | b", "c\\", ""]
    assert lists.split_row("a|b") == ["a", "b"] and lists.split_row("|a||b|") == ["a", "", "b"]
    assert lists.plain("**[Acme](http://x)** <br/>&nbsp;Inc") == "Acme Inc"


def test_sections():
    text = "## **Hudson**\n**Locations**: Chicago, IL\n| Role | Links |\n| --- | --- |\n| QT | [Apply](https://h.com/1) [Summer ✅](https://h.com/2?a=1&amp;b=2) |\n| Ops | [x](ftp://no) [Apply](https://h.com/3) 🔒 |\n## Jane\n| swe | [Apply](https://j.com/1) 🎓 |\n"
    got = [(r["row"], r["company"], r["title"], r["location"], r["apply_url"], r["closed"], r["degree"]) for r in lists.section_postings(text)]
    assert got == [
        (5, "Hudson", "Quantitative Trading Intern", "Chicago, IL", "https://h.com/1", False, False),
        (5, "Hudson", "Quantitative Trading Intern — Summer", "Chicago, IL", "https://h.com/2?a=1&b=2", False, False),
        (6, "Hudson", "Ops Intern", "Chicago, IL", "https://h.com/3", True, False),
        (8, "Jane", "Software Engineering Intern", "Unspecified", "https://j.com/1", False, True),
    ]


def test_data_source_and_postings(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAGE)
    (tmp_path / "b.md").write_text("")
    spark.dataSource.register(lists.PostingLists)
    df = spark.read.format("posting_lists").load(str(tmp_path))
    assert df.count() == 6 and df.select("document").distinct().count() == 1
    with pytest.raises(Exception, match="layout"):
        spark.read.format("posting_lists").option("layout", "none").load(str(tmp_path)).count()
    docs = spark.createDataFrame([("d", PAGE), ("e", PAGE), ("f", None)], "document string, value string")
    rows = {r["external_id"]: r for r in postings.list_postings(docs, "lists").collect()}
    assert len(rows) == 12
    assert rows["d:https://a.com/1?x=1&y=2"]["max_hourly"] == 55 and round(rows["d:https://apply.example.com/quant"]["max_hourly"], 2) == 57.69


def test_hashes_skip_unchanged_sources(spark):
    rows = spark.createDataFrame([("s", i, f"t{i}") for i in range(50)] + [("u", 1, None)], "source string, id int, title string")
    hashes = lists.snapshot_hash(rows, "source", "id", "title", fan=4)
    again = lists.snapshot_hash(rows.repartition(7, "title"), "source", "id", "title", fan=4)
    assert sorted(map(tuple, hashes.collect())) == sorted(map(tuple, again.collect()))
    other = lists.snapshot_hash(rows.withColumn("title", F.when(F.col("id") != 7, F.col("title"))), "source", "id", "title", fan=4)
    assert {r["source"] for r in lists.to_resolve(rows, other, hashes, "source").select("source").distinct().collect()} == {"s"}
