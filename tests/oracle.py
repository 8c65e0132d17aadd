"""Compare a query with its SQL under DuckDB, as multisets of rows with columns by name."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same_rows(df, sql: str, folder: str, digits: int | None = None) -> None:
    names = sorted(df.columns)
    rel = connect(folder).sql(sql)
    assert sorted(rel.columns) == names
    fix = lambda x: round(x, digits) if digits is not None and isinstance(x, float) else x
    rows = lambda rs, cols: Counter(tuple(fix(r[cols.index(n)]) for n in names) for r in rs)
    got, want = rows([tuple(r) for r in df.collect()], df.columns), rows(rel.fetchall(), rel.columns)
    assert got == want, f"only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
