"""Metrics against hand-made and brute-force values."""

import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators import metrics as M


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(500)]
    return spark.createDataFrame([(y, int(s > 0.5), s) for y, s in rows], "y int, p int, s double"), rows


def test_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    m = M.weighted_metrics(df, "y", "p").first()
    assert tuple(m) == pytest.approx((2 / 3, 4 / 9, 2 / 3, 8 / 15))
    assert tuple(M.binary_metrics(df, "y", "p").first()) == (0.0, 0.0, 0.0)


def test_matrix_keeps_empty_cells(spark):
    df = spark.createDataFrame([(1, 1)], "y int, p int")
    cells = {(r[0], r[1]): r[2] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_weighted_recall_is_accuracy(scored):
    m = M.weighted_metrics(scored[0], "y", "p").first()
    assert m["recall"] == pytest.approx(m["accuracy"])


def test_auc_is_the_share_of_ordered_pairs(scored):
    df, rows = scored
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(want)


def test_auc_of_the_other_class(scored):
    df = scored[0].withColumn("t", 1 - F.col("s"))
    assert M.roc_auc(df, "y", "t", positive=0).first()[0] == pytest.approx(M.roc_auc(df, "y", "s").first()[0])


def test_roc_points(scored):
    df, rows = scored
    points = M.roc_points(df, "y", "s").orderBy(F.col("threshold").desc_nulls_first()).collect()
    n_pos = sum(y for y, _ in rows)
    assert (points[0]["fpr"], points[0]["tpr"]) == (0.0, 0.0)
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    for p in points[1:]:
        assert p["tpr"] == pytest.approx(sum(y for y, s in rows if s >= p["threshold"]) / n_pos)


def test_roc_through_ranges(scored, monkeypatch):
    df, _ = scored
    plain = M.roc_auc(df, "y", "s").first()["auc"]
    odd = df.unionByName(df.limit(5).withColumn("s", F.lit(float("nan")))).unionByName(df.limit(5).withColumn("s", F.lit(None).cast("double")))
    assert M.roc_auc(odd, "y", "s").first()["auc"] == pytest.approx(plain)
    assert M.roc_points(odd, "y", "s").count() == M.roc_points(df, "y", "s").count()


def test_one_class_has_no_auc(spark):
    assert M.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


def test_a_request_is_one_log_row(spark):
    rows = [("a", i, 2.0) for i in range(12)] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "request string, row bigint, latency double").withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    log = M.scoring_log(df, "request", "latency", "t")
    assert [(r["request"], r["n_input_rows"], r["total_latency"]) for r in log.orderBy("request").collect()] == [("a", 12, 2.0), ("b", 1, 1.0)]
    assert tuple(M.latency_summary(log).first())[:3] == (2, 13, 3.0)


def test_classes_come_from_the_data(spark):
    df = spark.createDataFrame([(i % 4, i % 4 if i < 75 else (i + 1) % 4) for i in range(100)], "y int, p int")
    right = M.accuracy(df, "y", "p").first()["accuracy"]
    assert M.weighted_metrics(df, "y", "p").first()["accuracy"] == pytest.approx(right) == pytest.approx(0.75)
    assert M.confusion_matrix(df, "y", "p").count() == 16
    assert M.classification_report(df, "y", "p").count() == 7


def test_unusable_candidates_lose(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.9), ("c", float("nan"))], "model string, f1 double")
    assert M.best_candidate(df, "model", "f1").first()["model"] == "b"


def test_best_of_ties(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, f1 double")
    assert M.best_candidate(df, "model", "f1").first()["model"] == "a"


def test_contributions_sum_to_the_linear_score(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(5)], "id int, a double, b double")
    c = M.linear_contributions(df, {"a": 2.0, "b": -1.0}, ["id"]).orderBy("id").collect()
    mean = 2.0 * 2.0 - 6.0
    assert [r["a"] + r["b"] + mean for r in c] == pytest.approx([2 * i - i * i for i in range(5)])


def test_ten_thousand_classes(spark):
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("y"), F.when(F.col("id") < 30_000, F.col("id") % 10_000).otherwise(0).alias("p"))
    found = M.class_metrics(df, "y", "p")
    assert found.count() == 10_000 and found.agg(F.sum("hits"), F.sum("support")).first() == (30_001, 40_000)
    assert M.weighted_metrics(df, "y", "p").first()["accuracy"] == pytest.approx(30_001 / 40_000)


def test_rows_without_a_side_do_not_count(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), ("c", "a")], "y string, p string")
    got = {r["label"]: (r["support"], r["hits"]) for r in M.class_metrics(df, "y", "p").collect()}
    assert got == {"a": (1, 1), "b": (0, 0), "c": (1, 0)}
    assert M.confusion_matrix(df, "y", "p").count() == 9
    assert M.class_metrics(df, "y", "p", ["a"]).collect()[0]["support"] == 1


def test_histogram_of_values_that_are_not_finite(spark):
    from wardflow.operators.profile import histogram

    known = [(float(i),) for i in range(100)]
    df = spark.createDataFrame([*known, (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    rows = histogram(df, "x").orderBy("bin").collect()
    assert [tuple(r) for r in rows][0] == (-1, None, 3)
    assert [tuple(r) for r in rows][1:] == [tuple(r) for r in histogram(spark.createDataFrame(known, "x double"), "x").orderBy("bin").collect()]
    assert [tuple(r) for r in histogram(df.filter("isnan(x)"), "x").collect()][0] == (-1, None, 1)
