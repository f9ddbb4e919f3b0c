"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents"
          " embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return int(value) if isinstance(value, decimal.Decimal) and value == value.to_integral_value() else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """(rows of Spark, rows of DuckDB, up to three rows of each side the other lacks)."""
    frame = query(spark, sf_dir)
    columns = frame.columns
    left = rows_of(columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    assert sorted(columns) == sorted(names), (columns, names)
    if left == right:
        return len(left), len(right), [], []
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return len(left), len(right), only_left or ["multiplicity"], only_right
