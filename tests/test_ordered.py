"""Gap fill, positions and running totals: plain form, split form and brute force agree."""

import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows, half of those within a tiny range of the order."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 2 else f"k{rng.randrange(20)}"
        at = rng.randrange(1000) if i % 4 else 10_000_000 + i
        rows.append((key, at, i, rng.choice([None, None, None, rng.random()]), rng.choice([None, rng.randrange(9)])))
    rows.append((None, 1, 600, 1.0, 1))
    return spark.createDataFrame(rows, "key string, at bigint, id bigint, x double, y bigint"), rows


def filled(rows, back):
    """Row by row: the next known value, then the previous one."""
    groups = {}
    for r in rows:
        if r[0] is not None:
            groups.setdefault(r[0], []).append(r)
    out = {}
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]))
        for i, r in enumerate(group):
            values = []
            for c in (3, 4):
                after = [g[c] for g in group[i:] if g[c] is not None]
                before = [g[c] for g in group[: i + 1] if g[c] is not None]
                values.append((after[0] if after and back else None) if (after and back) else (before[-1] if before else None))
            out[r[2]] = tuple(values)
    return out


@pytest.mark.parametrize("max_rows", [1_000_000, 40, 7])
@pytest.mark.parametrize("direction", ["both", "forward"])
def test_fill(skewed, max_rows, direction):
    df, rows = skewed
    got = O.fill_gaps(df, "key", ["at", "id"], ["x", "y"], direction, max_rows)
    assert {r["id"]: (r["x"], r["y"]) for r in got.collect()} == filled(rows, direction == "both")


def test_fill_twice_changes_nothing(skewed):
    once = O.drop_parts(O.fill_gaps(skewed[0], "key", ["at", "id"], ["x", "y"], max_rows=40))
    twice = O.drop_parts(O.fill_gaps(once, "key", ["at", "id"], ["x", "y"], max_rows=40))
    assert once.exceptAll(twice).isEmpty() and once.count() == twice.count()


def test_split_bounds_groups_and_keeps_order(skewed):
    df, _ = skewed
    split = O.split_hot(df.filter("key IS NOT NULL"), "key", ["at", "id"], 40)
    sizes = split.groupBy("key", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    assert O.HOT in split.columns
    ranges = sorted(
        (r["key"], r["_part"], r["lo"], r["hi"])
        for r in split.groupBy("key", "_part").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    )
    for a, b in zip(ranges, ranges[1:]):
        assert a[0] != b[0] or a[3] <= b[2]


def test_plain_tables_keep_one_part(skewed):
    split = O.split_hot(skewed[0], "key", ["at"])
    assert O.HOT not in split.columns
    plan = O.fill_gaps(skewed[0], "key", ["at", "id"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("max_rows", [1_000_000, 40, 7])
def test_position(skewed, max_rows):
    df, rows = skewed
    got = {r["id"]: r["position"] for r in O.row_position(df, "key", ["at", "id"], max_rows).collect()}
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want[r[2]] = seen[r[0]]
    assert got == want


def test_split_bounds_equal_order_values(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.lit(1).alias("at"), "id")
    sizes = O.split_hot(df, "key", ["at"], 40).groupBy("key", "_part").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (40, 1000)


@pytest.mark.parametrize("partitions", [1, 3, 8])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, partitions, descending):
    df, rows = skewed
    order = [F.col("at").desc() if descending else "at", "id"]
    got = O.running_totals(df.repartition(partitions), order, {"total": F.col("id")})
    got = {r["id"]: (r["position"], r["total"]) for r in got.collect()}
    want, total = {}, 0
    for i, r in enumerate(sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[2]))):
        total += r[2]
        want[r[2]] = (i + 1, total)
    assert got == want


def test_running_totals_with_nulls_and_nan(spark):
    rows = [(None, 1), (None, 2), (1.5, 3), (0.5, 4), (2.5, 5), (0.5, 6), (float("nan"), 7), (float("inf"), 8), (float("-inf"), 9)]
    got = O.running_totals(spark.createDataFrame(rows, "at double, id bigint"), ["at", "id"])
    assert [r["id"] for r in got.orderBy("position").collect()] == [1, 2, 9, 4, 6, 3, 5, 8, 7]


def test_running_totals_of_long_common_prefixes(spark):
    words = [f"patient-{i:06d}" for i in range(300)] + ["", "é", "Z"]
    got = O.running_totals(spark.createDataFrame([(w,) for w in words], "w string").repartition(4), ["w"])
    assert [r["w"] for r in got.orderBy("position").collect()] == sorted(words, key=str.encode)
