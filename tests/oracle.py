"""Holds queries against their SQL in DuckDB: columns, and rows as a multiset."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    theirs = con.execute(sql)
    want = rows([c[0] for c in theirs.description], theirs.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
