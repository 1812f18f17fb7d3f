"""A query's rows against its SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names: list[str]) -> Counter:
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x

    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(v[i]) for i in order) for v in values)


def sql_rows(sql: str, sf_dir: str) -> tuple[Counter, list[str]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return rows(found.fetchall(), names), sorted(names)


def assert_same(df, sql: str, sf_dir: str) -> None:
    want, names = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got == want, f"{list((got - want).items())[:3]} {list((want - got).items())[:3]}"
