"""Jobs and streams end to end, on raw observations of the test tables and small grids."""

import pytest
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.ordered import drop_parts
from wardflow.operators.sampling import group_split
from wardflow.plans import jobs, training
from wardflow.plans.model_catalog import request_lines
from wardflow.plans.observations import raw_observations
from wardflow.sources import readers, writers
from wardflow.streaming import streams

GRIDS = {"Logistic_Regression": {"C": [1.0]}, "Decision_Tree": {"maxDepth": [3]}}


@pytest.fixture(scope="module")
def halves(spark):
    raw = drop_parts(raw_observations(spark, "/root/testdata/sf0.01")).drop("event_id")
    sides = group_split(raw, share=0.5).persist()
    return [sides.filter(f"side = '{s}'").drop("side") for s in ("train", "test")]


@pytest.fixture(scope="module")
def artifacts(tmp_path_factory):
    return str(tmp_path_factory.mktemp("artifacts"))


@pytest.fixture(scope="module")
def first(spark, halves, artifacts):
    return jobs.first_run(spark, halves[0], artifacts, GRIDS, folds=2, stamp="20240101-000000")


def test_first_run(spark, first, artifacts):
    path, found, findings = first
    assert findings.count() == 0
    assert 0.5 < found["accuracy"] <= 1.0
    assert readers.latest_run(spark, f"{artifacts}/models")["run"] == "model-run-20240101-000000"
    features = spark.read.parquet(f"{artifacts}/features")
    both = features.groupBy(S.KEY).agg(F.count_distinct("side").alias("n"))
    assert both.filter("n > 1").isEmpty()
    train = features.filter("side = 'train'").agg(F.avg("HR"), F.stddev_pop("HR")).first()
    assert tuple(train) == pytest.approx((0.0, 1.0), abs=1e-9)


def test_batch_run(spark, halves, first, artifacts):
    out = jobs.batch_run(spark, halves[1], "batch-1", artifacts, GRIDS, 2, "20240102-000000")
    assert out["next_batch"] == "batch-2"
    merged = writers.Versioned(spark, f"{artifacts}/data").read()
    assert merged.count() == halves[0].count() + halves[1].count()
    assert out["decision"]["decision"] in ("keep", "warn", "retrain")
    assert (out["model"] is not None) == (out["decision"]["decision"] == "retrain")


def test_drifted_batch_retrains(spark, halves, first, artifacts):
    flipped = halves[1].withColumn(S.LABEL, 1 - F.col(S.LABEL)).filter(F.rand(1) < 0.2).drop("side")
    few = flipped.withColumn(S.KEY, F.concat(F.lit("x"), S.KEY))
    out = jobs.batch_run(spark, few, "batch-2", artifacts, GRIDS, 2, "20240103-000000")
    assert out["decision"]["decision"] == "retrain"
    assert readers.latest_run(spark, f"{artifacts}/models")["run"] == "model-run-20240103-000000"


def test_broken_batch_is_refused(spark, halves, first, artifacts):
    before = writers.Versioned(spark, f"{artifacts}/data").read().count()
    with pytest.raises(jobs.ValidationFailed) as failed:
        jobs.batch_run(spark, halves[1].drop("HR"), "batch-3", artifacts, GRIDS)
    assert failed.value.findings.filter("rule = 'missing_column'").count() == 1
    assert writers.Versioned(spark, f"{artifacts}/data").read().count() == before


@pytest.mark.parametrize("name", list(training.ESTIMATORS))
def test_fit_is_repeatable(spark, halves, name):
    scaled, _ = jobs.prepare_and_scale(halves[0].limit(2000))
    train, validation = training.training_sets(scaled, jobs.ROW, by_patient=True)
    small = {"Random_Forest_Classifier": {"numTrees": 3}, "Gradient_Boosted_Trees": {"maxIter": 2}}.get(name)
    a, b = (
        training.predictions(training.fit(train, name, small), validation).select(*jobs.ROW, "prediction").collect()
        for _ in range(2)
    )
    assert sorted(a) == sorted(b)
    assert {r["prediction"] for r in a} <= {0, 1}


def test_grid_results(spark, halves):
    scaled, _ = jobs.prepare_and_scale(halves[0])
    train, _ = training.training_sets(scaled, jobs.ROW)
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [2, 5]}
    _, results = training.grid_search(train, "Decision_Tree", grid, jobs.ROW, folds=2, score="weighted_recall")
    assert results.count() == 4
    assert results.filter("mean_score BETWEEN 0 AND 1").count() == 4


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def land(name, hours):
        rows = ["|".join(str({"ICULOS": h, "Gender": 1, "SepsisLabel": 0}.get(c, "NaN")) for c in S.RAW_FILE.names) for h in range(1, hours + 1)]
        (landing / name).write_text("\n".join(["|".join(S.RAW_FILE.names), *rows]) + "\n")

    def run():
        streams.ingest(streams.patient_stream(spark, str(landing)), out, checkpoint)
        return {r[0]: r[1] for r in spark.read.parquet(out).groupBy(S.KEY).count().collect()}

    land("p1.psv", 2)
    assert run() == {"p1": 2}
    land("p2.psv", 3)
    assert run() == {"p1": 2, "p2": 3}
    assert run() == {"p1": 2, "p2": 3}


def test_stream_scores_requests(spark, halves, first, artifacts, tmp_path):
    lines = request_lines(spark, "/root/testdata/sf0.001").withColumn("arrived", F.current_timestamp())
    bad = spark.createDataFrame([("bad", "{}")], "request string, value string").withColumn("arrived", F.current_timestamp())
    writers.save_table(lines.unionByName(bad), f"{tmp_path}/lines")
    stream = streams.file_stream(spark, f"{tmp_path}/lines", spark.read.parquet(f"{tmp_path}/lines").schema, "parquet")
    streams.score_stream(stream, lambda rows: jobs.score_requests(spark, rows, artifacts), f"{tmp_path}/out", f"{tmp_path}/cp")
    scored = spark.read.parquet(f"{tmp_path}/out/scored")
    assert scored.count() == 1000
    refused = spark.read.parquet(f"{tmp_path}/out/rejects").collect()
    assert [(r["request"], r["reason"], r["value"]) for r in refused] == [("bad", "no JSON payload", "{}")]
    log = spark.read.parquet(f"{tmp_path}/out/log")
    assert log.agg(F.sum("n_input_rows")).first()[0] == 1000
    assert log.filter("total_latency < 0").isEmpty()


def test_scoring_finds_the_anomalous_request(spark, first, artifacts, tmp_path):
    lines = request_lines(spark, "/root/testdata/sf0.001").withColumn("arrived", F.current_timestamp())
    names = ", ".join(f'"{c}"' for c in S.REQUEST_COLUMNS)
    cells = ", ".join({"HR": "1e6", "Patient_ID": '"odd"', "ICULOS": "1"}.get(c, "null") for c in S.REQUEST_COLUMNS)
    odd = spark.createDataFrame([("odd", f'{{"data": [[{cells}]], "columns": [{names}]}}')], "request string, value string")
    writers.save_table(lines.unionByName(odd.withColumn("arrived", F.current_timestamp())), f"{tmp_path}/lines")
    stream = streams.file_stream(spark, f"{tmp_path}/lines", spark.read.parquet(f"{tmp_path}/lines").schema, "parquet")
    streams.score_stream(stream, lambda rows: jobs.score_requests(spark, rows, artifacts), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out/scored").count() == 1001
    found = spark.read.parquet(f"{tmp_path}/out/anomalies").filter("request = 'odd'").collect()
    assert "HR" in {r["column_name"] for r in found}


def test_windows_wait_for_late_rows(spark, tmp_path):
    (tmp_path / "log").mkdir()
    schema = "timestamp timestamp, n_input_rows bigint, total_latency double"

    def land(name, times):
        df = spark.createDataFrame([(t, 1, 2.0) for t in times], "t string, n_input_rows bigint, total_latency double")
        df.select(F.col("t").cast("timestamp").alias("timestamp"), "n_input_rows", "total_latency").write.parquet(f"{tmp_path}/log/{name}")

    def run():
        log = streams.file_stream(spark, f"{tmp_path}/log/*", spark.createDataFrame([], schema).schema, "parquet")
        streams.run_windows(streams.latency_windows(log), f"{tmp_path}/out", f"{tmp_path}/cp")
        return sorted((str(r["start"])[11:16], r["requests"], r["total_latency"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    land("a", ["2024-01-01 10:10:00", "2024-01-01 10:20:00", "2024-01-01 11:30:00"])
    assert run() == []
    land("b", ["2024-01-01 10:50:00", "2024-01-01 14:00:00"])
    assert run() == [("10:00", 3, 6.0), ("11:00", 1, 2.0)]
    land("c", ["2024-01-01 10:55:00"])
    assert run() == [("10:00", 3, 6.0), ("11:00", 1, 2.0)]


def test_staged_boosting_equals_separate_fits(spark, halves, tmp_path):
    """One fit for all numbers of rounds scores as fits of their own do, and is not repeated."""
    scaled, _ = jobs.prepare_and_scale(halves[0].limit(3000))
    train, _ = training.training_sets(scaled, jobs.ROW)
    name, store = "Gradient_Boosted_Trees", f"{tmp_path}/search"
    grid = {"maxIter": [1, 2, 4], "maxDepth": [2], "stepSize": [0.2]}
    _, results = training.grid_search(train, name, grid, jobs.ROW, folds=2, store=store)
    found = {r["params"]["maxIter"]: r for r in results.collect()}
    for rounds in grid["maxIter"]:
        one = training.grid_search(train, name, {**grid, "maxIter": [rounds]}, jobs.ROW, folds=2)[1].first()
        assert one["fold_scores"] == pytest.approx(found[str(rounds)]["fold_scores"], abs=1e-12)
    assert all(len(r["fold_scores"]) == 2 and r["training_time"] > 0 for r in found.values())
    again = training.grid_search(train, name, grid, jobs.ROW, folds=2, store=store)[1].collect()
    assert {r["params"]["maxIter"]: (r["fold_scores"], r["training_time"]) for r in again} == {k: (r["fold_scores"], r["training_time"]) for k, r in found.items()}


def test_each_setting_has_its_own_time(spark, halves):
    scaled, _ = jobs.prepare_and_scale(halves[0].limit(2000))
    train, _ = training.training_sets(scaled, jobs.ROW)
    grid = {"maxDepth": [1, 5], "minInstancesPerNode": [1, 2]}
    _, results = training.grid_search(train, "Decision_Tree", grid, jobs.ROW, folds=2)
    assert results.count() == 4 and results.select("training_time").distinct().count() == 4
