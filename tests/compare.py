"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(names).collect())


def sql_rows(sql, sf_dir):
    with duckdb.connect() as con:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
