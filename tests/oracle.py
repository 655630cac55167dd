"""Compares a query with its SQL in DuckDB."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else str(x)


def compare(con, spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    con.execute(f"SELECT * FROM ({sql}) LIMIT 0")
    assert names == sorted(c[0] for c in con.description)
    got = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    want = Counter(tuple(map(plain, r)) for r in con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall())
    assert got == want
