"""Exact quantiles with and without brackets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.functions.quantiles import exact_quantiles
from wardflow.operators import profile as R


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [
        (rng.gauss(0, 1), rng.choice([1.0, 2.0]), float(rng.randrange(5)) if i % 3 else None, None)
        for i in range(4000)
    ]
    rows[0] = (1e12, *rows[0][1:])
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(16), rows


@pytest.mark.parametrize("accuracy", [10_000, 1000, 100, 40])
@pytest.mark.parametrize("shares", [(0.5,), (0.25, 0.5, 0.75), (0.0, 0.99, 1.0)])
def test_matches_brute_force(table, accuracy, shares):
    df, rows = table
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["a", "b", "c", "d"], shares, accuracy).collect()}
    assert len(got) == 4 * len(shares)
    for i, c in enumerate("abcd"):
        known = [r[i] for r in rows if r[i] is not None]
        for q in shares:
            want = np.quantile(known, q) if known else None
            assert got[c, q] == (pytest.approx(want, rel=1e-12) if known else None)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_small_columns(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "a double")
    got = [r[2] for r in exact_quantiles(df, ["a"], (0.25, 0.5, 0.75)).orderBy("share").collect()]
    assert got == pytest.approx(list(np.quantile([i * i for i in range(n)], [0.25, 0.5, 0.75])))


def test_profile_of_an_empty_column(table):
    row = R.profile_numeric(table[0], ["d"]).first()
    assert row["min"] is row["max"] is row["mean"] is row["median"] is row["std"] is None
    assert row["null_count"] == row["n_rows"] == 4000


def test_profile_of_an_empty_table(spark):
    row = R.profile_numeric(spark.createDataFrame([], "a double")).first()
    assert row["median"] is None and row["n_rows"] == 0


def test_many_columns_are_values_in_rows(spark):
    """No aggregate has a function for each column, and tables without rows give rows without values."""
    names = [f"c {i}" for i in range(40)]
    df = spark.range(101).select(*[((F.col("id") * 7 + i) % 101).cast("double").alias(c) for i, c in enumerate(names)])
    df = df.withColumn("d", F.col("`c 0`").cast("decimal(12,2)"))
    plans, collected = [], type(df).collect
    stats = {"null_count": ("count_if({c} IS NULL)", "bigint"), "mean": ("avg({c})", "double")}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "collect", lambda self: (plans.append(len(self.schema)), collected(self))[1])
        found = exact_quantiles(df, [*names, "d"], (0.5,), stats=stats)
    assert plans and max(plans) < 10
    assert {r["column_name"]: (r["value"], r["null_count"], r["mean"]) for r in found.collect()} == {c: (50.0, 0, 50.0) for c in [*names, "d"]}
    empty = exact_quantiles(df.filter("false"), names[:2], (0.5,), stats=stats).collect()
    assert [(r["value"], r["null_count"], r["mean"]) for r in empty] == [(None, 0, None)] * 2
