"""Findings of changed tables against a recorded profile."""

import pytest
from pyspark.sql import functions as F

from wardflow.operators import profile as R
from wardflow.operators import validate as V


@pytest.fixture(scope="module")
def base(spark):
    rows = [(f"p{i % 5}", i, float(i % 10), float(30 + i % 3), "ab"[i % 2], i % 2) for i in range(100)]
    return spark.createDataFrame(
        rows, "Patient_ID string, ICULOS bigint, HR double, Age double, ward string, SepsisLabel bigint"
    )


@pytest.fixture(scope="module")
def recorded(base):
    text = ["ward"]
    return R.recorded_schema(base), R.profile_numeric(base).persist(), R.profile_values(base, text).persist()


def rules(df, recorded, **kw):
    return sorted((r["rule"], r["column_name"]) for r in V.monitor(df, *recorded, **kw).collect())


def test_same_table_has_no_findings(base, recorded):
    assert rules(base, recorded, skip=()) == []


def test_missing_column_and_wrong_type(base, recorded):
    changed = base.drop("HR").withColumn("ward", F.lit(1.0))
    assert rules(changed, recorded) == [("missing_column", "HR"), ("missing_statistics", "HR"), ("wrong_type", "ward")]


def test_age_may_be_whole(base, recorded):
    assert rules(base.withColumn("Age", F.col("Age").cast("bigint")), recorded) == []


def test_first_only(base, recorded):
    found = V.schema_findings(R.recorded_schema(base.drop("HR", "ward")), recorded[0], first_only=True)
    assert [r["column_name"] for r in found.collect()] == ["HR"]


def test_null_key(base, recorded):
    changed = base.withColumn("Patient_ID", F.when(F.col("ICULOS") > 3, F.col("Patient_ID")))
    found = V.monitor(changed, *recorded).filter("rule = 'null_key'").first()
    assert (found["severity"], found["observed"]) == ("error", "4.0")


def test_shifted_values(base, recorded):
    found = rules(base.withColumn("HR", F.col("HR") + 50), recorded)
    assert found == [("max", "HR"), ("mean", "HR"), ("median", "HR")]


def test_new_nulls_and_values(base, recorded):
    changed = base.withColumns(
        {"HR": F.when(F.col("ICULOS") != 50, F.col("HR")), "ward": F.when(F.col("ICULOS") == 1, "c").otherwise(F.col("ward"))}
    )
    assert rules(changed, recorded) == [("null_count", "HR"), ("unique_values", "ward")]


def test_missing_value_is_found(base, recorded):
    assert ("unique_values", "ward") in rules(base.withColumn("ward", F.lit("a")), recorded)


def test_label_is_skipped_by_the_monitor(base, recorded):
    assert rules(base.drop("SepsisLabel"), recorded) == []


@pytest.mark.parametrize("path,strict,action", [("data/initial", False, "split"), ("data/batch-2", False, "score_batch"), ("x", True, "alert")])
def test_next_action(base, recorded, path, strict, action):
    findings = V.monitor(base.withColumn("HR", F.col("HR") + 50), *recorded)
    assert V.next_action(findings, path, strict).first()["action"] == action


@pytest.mark.parametrize("new,decision", [(0.9, "keep"), (0.875, "keep"), (0.87, "warn"), (0.84, "retrain"), (1.0, "keep")])
def test_drift(spark, new, decision):
    m = spark.createDataFrame([(0.9, new)], "old_recall double, new_recall double")
    assert V.model_drift(m).first()["decision"] == decision


def test_drift_of_zero_recall(spark):
    m = spark.createDataFrame([(0.0, 0.5)], "old_recall double, new_recall double")
    assert V.model_drift(m).first()["decision"] == "keep"


def test_anomaly_signs(spark):
    recorded = spark.createDataFrame([("a", -1.0, 1.0), ("b", 0.0, 1.0), ("c", 5.0, 1.0)], "column_name string, mean double, std double")
    df = spark.createDataFrame([(-90.0, 3.0, None), (-91.0, 4.0, None)], "a double, b double, c double")
    names = ["a", "b", "c"]
    assert {r["column_name"] for r in V.request_anomalies(df, recorded, names).collect()} == {"a", "b"}
    assert {r["column_name"] for r in V.request_anomalies(df, recorded, names, legacy_sign=True).collect()} == {"b"}


def test_anomaly_of_one_request_among_many(spark):
    recorded = spark.createDataFrame([("a", 10.0, 1.0)], "column_name string, mean double, std double")
    rows = [(str(i), 10.0 + j) for i in range(50) for j in (-1.0, 0.0, 1.0)] + [("odd", 99.0), ("odd", 101.0), ("empty", None)]
    df = spark.createDataFrame(rows, "request string, a double")
    assert V.request_anomalies(df.filter("request <> 'odd'"), recorded, ["a"], request="request").isEmpty()
    got = V.request_anomalies(df, recorded, ["a"], request="request").collect()
    assert [(r["request"], r["column_name"], r["mean_percent"]) for r in got] == [("odd", "a", 900.0)]


def test_batches(spark):
    df = spark.createDataFrame([(None,), ("batch-3",), ("batch-4",)], "batch string")
    got = [(r["next_batch"], r["state"]) for r in V.next_batch(df).collect()]
    assert got == [("batch-2", "run"), ("batch-4", "run"), ("batch-5", "stop")]


def test_alert_lines(base, recorded):
    found = V.alert_text(V.monitor(base.drop("HR"), *recorded), "nightly").first()
    assert found["message"].endswith("[nightly] error: column HR, rule missing_column, expected float64, observed nothing")
