"""Run a registered query in Spark and its SQL in DuckDB and compare the rows.

Both sides round doubles to 6 places. Sums in another order differ in the last bits, so a
value on a rounding border may differ by one unit of the last place; everything else is exact.
"""

import glob
import math
import os

import duckdb

UNIT = 1.5e-6


def duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v


def sort_key(row):
    exact = tuple((v is not None, str(v)) for v in row if not isinstance(v, float))
    return exact, tuple(round(v, 3) for v in row if isinstance(v, float))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=sort_key)


def differences(got, want):
    """Pairs of rows that differ by more than a rounding border."""

    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return abs(a - b) <= UNIT
        return a == b

    return [(a, b) for a, b in zip(got, want) if not all(same(x, y) for x, y in zip(a, b))]


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(connection, sql):
    found = connection.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())
