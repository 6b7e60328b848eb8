"""The prepare step on a small two-patient table, and scaling."""

import math

import pytest
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators import joins as J
from wardflow.operators import prepare as P
from wardflow.operators.sampling import group_split


@pytest.fixture(scope="module")
def small(spark):
    redundant = {c: float(i) for i, c in enumerate(S.REDUNDANT)}
    rows = []
    for i in range(4):
        rows.append(
            {
                "Patient_ID": i // 2 + 1, "hour": i % 2, "SepsisLabel": int(i in (0, 3)),
                **{c: v + i for c, v in redundant.items()},
                "TroponinI": [0.1, 0.2, None, None][i], "Bilirubin_direct": [0.5, None, 0.7, 0.8][i],
                "AST": 20.0 + i, "Bilirubin_total": 1.0, "Lactate": 1.5, "SaO2": 95.0, "FiO2": 21.0,
                "MAP": 70.0 + 5 * i, "BUN": 10.0 + 5 * i, "Creatinine": 0.9 + i, "Glucose": 100.0 + i,
                "WBC": 5.0 + i, "Platelets": 200.0 + i, "Gender": "MFMF"[i], "Unnamed: 0": i,
            }
        )
    fields = ["Patient_ID bigint", "hour int", "SepsisLabel bigint", "Gender string", "`Unnamed: 0` bigint"]
    floats = [c for c in rows[0] if c not in ("Patient_ID", "hour", "SepsisLabel", "Gender", "Unnamed: 0")]
    names = ["Patient_ID", "hour", "SepsisLabel", "Gender", "Unnamed: 0", *floats]
    schema = ", ".join([*fields, *[f"{c} double" for c in floats]])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def prepared(small):
    return P.prepare_features(small, order=("hour",)).persist()


def test_redundant_columns_are_gone(prepared):
    assert not set(S.REDUNDANT + S.SPARSE) & set(prepared.columns)


def test_no_nulls(prepared):
    assert prepared.count() == 4
    assert prepared.na.drop().count() == 4


def test_logged_columns_are_positive(prepared):
    low = prepared.agg(*[F.min(c).alias(c) for c in S.LOGGED]).first()
    assert all(low[c] > 0 for c in S.LOGGED)


def test_gender_is_one_hot(prepared):
    assert "Gender" not in prepared.columns
    assert {(r["F"], r["M"]) for r in prepared.collect()} == {(0, 1), (1, 0)}


def test_output_columns(prepared):
    assert set(prepared.columns) - {"Patient_ID", "hour", "SepsisLabel"} == {*S.LOGGED, "M", "F"}


def test_columns_that_cannot_matter_are_not_read(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "t"))
    plan = P.prepare_features(spark.read.parquet(str(tmp_path / "t")), order=("hour",))._jdf.queryExecution()
    assert "TroponinI" not in plan.executedPlan().toString()


def test_fill_directions_differ(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 7.0), ("a", 3, None), (None, 4, 1.0)], "Patient_ID string, ICULOS bigint, HR double")
    both = P.prepare_features(df).orderBy("ICULOS").collect()
    forward = P.prepare_features(df, direction="forward").orderBy("ICULOS").collect()
    assert [r["HR"] for r in both] == [7.0, 7.0, 7.0]
    assert [r["HR"] for r in forward] == [7.0, 7.0]


def test_unknown_gender_is_kept(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 2), ("b", 1, None)], "Patient_ID string, ICULOS bigint, Gender bigint")
    rows = {(r["Patient_ID"], r["ICULOS"]): (r["F"], r["M"]) for r in P.prepare_features(df).collect()}
    assert rows == {("a", 1): (1, 0), ("a", 2): (0, 0), ("b", 1): (0, 0)}


def test_scaler(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i * i)) for i in range(10)], "HR double, Temp double, WBC double")
    fitted = P.scaler_fit(df, ["HR", "Temp"])
    scaled = P.scaler_apply(df, fitted, ["HR", "Temp"]).agg(
        F.avg("HR"), F.stddev_pop("HR"), F.avg("Temp"), F.stddev_pop("Temp"), F.sum("WBC")
    ).first()
    assert tuple(scaled) == pytest.approx((0.0, 1.0, 0.0, 0.0, 285.0))


def test_prepare_then_split_equals_split_then_prepare(spark, folder):
    from wardflow.plans.observations import observations

    o = observations(spark, folder).drop("ts", "event_id")
    late = group_split(P.prepare_features(o)).filter("side = 'test'").drop("side")
    early = P.prepare_features(group_split(o).filter("side = 'test'").drop("side"))
    assert late.count() == early.count() and late.exceptAll(early.select(late.columns)).isEmpty()


def test_mean_fill_uses_the_fitted_table(spark):
    fit = P.mean_fit(spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double"), ["a"])
    got = P.mean_apply(spark.createDataFrame([(None,), (9.0,)], "a double"), fit, ["a"])
    assert sorted(r[0] for r in got.collect()) == [2.0, 9.0]


def test_declared_types(spark):
    df = spark.createDataFrame([("1.5", "x", "3", 12.0), (None, "2", "?", None)], "HR string, Temp string, Gender string, Patient_ID double")
    assert [tuple(r) for r in P.cast_declared(df).collect()] == [(1.5, None, 3, "12"), (None, 2.0, None, "")]


def test_union_aligns_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, x double")
    b = spark.createDataFrame([("y", 2)], "z string, id int")
    assert sorted(map(str, map(tuple, J.append_batch(a, b).collect()))) == ["(1, 2.0, None)", "(2, None, 'y')"]


def test_logs(spark):
    from wardflow.functions import scalars as X

    df = spark.createDataFrame([(-5.0,), (0.0,), (None,), (3.0,)], "a double")
    got = [tuple(r) for r in df.select(X.log1p("a"), X.clipped_log("a"), X.mirrored_log("a")).collect()]
    two = math.log(2)
    assert got[0] == (None, 0.0, pytest.approx(math.log(7)))
    assert got[1] == (0.0, 0.0, pytest.approx(two))
    assert got[2] == (None, None, None)
    assert got[3] == (pytest.approx(math.log(4)), pytest.approx(math.log(4)), pytest.approx(two))
