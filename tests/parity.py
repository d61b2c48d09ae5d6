"""Comparison of a query's rows with those of its SQL in DuckDB."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if hasattr(value, "__int__") and not hasattr(value, "isoformat"):
        return round(float(value), 6) if float(value) != int(value) else int(value)
    return str(value)


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def same(spark, sf_dir: str, query, sql: str) -> tuple[Counter, Counter]:
    """Rows only the query has, and rows only the SQL has."""
    df = query(spark, sf_dir)
    ours = multiset(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection(sf_dir).execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = multiset(columns, cursor.fetchall())
    return ours - theirs, theirs - ours
