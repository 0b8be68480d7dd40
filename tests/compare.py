"""Row-by-row comparison of a registered query with its DuckDB oracle."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    return [c.lower() for c in rel.columns], [str(t) for t in rel.types], rel.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


WIDTHS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark_df, sql: str, sf_dir: str):
    """None if equal, else a short description."""
    columns, types, data = oracle(sql, sf_dir)
    have = [c.lower() for c in spark_df.columns]
    if sorted(have) != sorted(columns):
        return f"columns {sorted(have)} against {sorted(columns)}"
    kinds = dict(zip(columns, types, strict=True))
    odd = {c: (k, kinds[c.lower()]) for c, k in spark_df.dtypes if WIDTHS.get(k, k) != kinds[c.lower()]}
    ours = rows(have, [tuple(r) for r in spark_df.collect()])
    theirs = rows(columns, data)
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a - b)[:2]}; only oracle {sorted(b - a)[:2]}; types {odd}"
    return f"types {odd}" if odd else None
