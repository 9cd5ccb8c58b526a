"""Run a query in Spark and its SQL in DuckDB and compare all rows."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return c


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(v[i]) for i in order) for v in values), [names[i] for i in order]


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    r = connection.sql(sql)
    return rows(r.columns, r.fetchall())


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def kinds_differ(df, connection, sql):
    """Columns whose types aren't alike: (name, Spark's, DuckDB's)."""
    r = connection.sql(sql)
    duck = dict(zip(r.columns, map(str, r.types), strict=True))
    return [(n, k, duck.get(n)) for n, k in df.dtypes if KINDS.get(k, k) != duck.get(n)]
