"""Quality rules against plain counting, with nulls, repeats, long texts and lines of many documents."""

import re
from collections import Counter, defaultdict

from oracle import TABLES, rows as counted
import duckdb

from gleaner.llm import quality

DOCS = "doc_id long, source string, text string, host string, line int, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def expected(rows, least=20, share=0.01, min_words=50, most=50, depleted=0.3):
    holders, hosts = defaultdict(set), defaultdict(set)
    for i, source, text in rows:
        host = source or ""
        if i is not None:
            hosts[host].add(i)
            for line in {plain(x) for x in (text or "").split("\n") if WORD.search(x)}:
                holders[host, line].add(i)
    bad = {k for k, v in holders.items() if len(v) > max(least, share * len(hosts[k[0]]))}
    out = []
    for i, source, text in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if (source or "", plain(x)) in bad)
        failed = len(words) < min_words or 100 * len(repeated) > most * len(words)
        stay = len(words) - gone
        kept = not failed and (gone == 0 or (stay >= min_words and stay >= depleted * len(words)))
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, kept, gone))
    return sorted(out, key=str)


def text(k, n=60):
    return " ".join(f"w{k}x{j}" for j in range(n))


FOOTER = "All rights  reserved 2024"
ROWS = [(i, "a", f"{text(i)}\n{FOOTER}") for i in range(25)]  # 25 documents share a line: it goes
ROWS += [(900, "b", f"{text(900)}\n{FOOTER}")] * 30  # one document, thirty times: its lines stay
ROWS += [(None, "c", f"{text(901)}\n{FOOTER}")] * 30  # no key: no document
ROWS += [(1000 + i, None, f"{text(i, 20)}\n{text(7, 31)}") for i in range(22)]  # a host without a name; depleted
ROWS += [(2000, "a", None), (2001, "a", ""), (2002, "a", "# * | short"), (2003, "a", "same three words " * 40), (2004, "a", " ".join(f"q{j % 700}" for j in range(30_000))), (3, "a", f"{text(3)}\n{FOOTER}")]


def test_rules_equal_plain_counting(spark):
    df = spark.createDataFrame([(*r, "h", 1, "n") for r in ROWS], DOCS)
    got = quality.apply_quality_rules(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)
    removed = {r["doc_id"]: r["n_removed_words"] for r in got}
    assert removed[0] == 4 and removed[900] == 0 and removed[1000] == 31 and not {r["kept"] for r in got if r["doc_id"] == 1000}.pop()
    assert quality.apply_quality_rules(df.limit(0)).count() == 0
    left = quality.remove_frequent_lines(df).where("doc_id = 1").first()
    assert left["text"] == text(1) and left["host"] == "h"


def test_sql_says_the_same_of_repeats_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(*r, "h", 1, "n") for r in ROWS], DOCS)
    df.select("doc_id", "source", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(quality.OP9_SQL)
    names = [d[0] for d in found.description]
    mine = quality.op9_quality_rules(spark, str(tmp_path))
    assert counted(found.fetchall(), names) == counted([tuple(r) for r in mine.collect()], mine.columns) and "documents" in TABLES
