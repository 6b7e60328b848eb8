"""End-to-end jobs: first training run, batch scoring and retraining, request scoring, monitoring."""

import uuid
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators import metrics as M
from wardflow.operators import prepare as P
from wardflow.operators import validate as V
from wardflow.operators.joins import append_batch
from wardflow.operators.sampling import group_split
from wardflow.plans import training
from wardflow.session import materialize
from wardflow.sources import readers, writers

ROW = ["Patient_ID", "ICULOS"]  # unique row key of an observation table
FITTED = "column_name string, mean double, std double"
METRICS = "model string, accuracy double, precision double, recall double, f1_score double"


class ValidationFailed(Exception):
    """Findings that stop a job; `findings` holds them as a DataFrame."""

    def __init__(self, findings):
        super().__init__("validation failed")
        self.findings = findings


def check(df, profile, path, strict=False):
    """Findings of df against a saved profile; raises when the next step would be an alert."""
    findings = materialize(V.monitor(df, profile["schema"], profile["statistics"], profile["values"], skip=()))
    if V.next_action(findings, path, strict).first()["action"] == "alert":
        raise ValidationFailed(findings)
    return findings


def prepare_and_scale(df, scaler_path=None, keep=()):
    """(rows, fitted scaler): fitted on the rows marked train, or read from scaler_path."""
    prepared = materialize(P.prepare_features(df, keep=keep))
    if scaler_path:
        fitted = readers.json_table(df.sparkSession, scaler_path, FITTED)
    else:
        fitted = P.scaler_fit(prepared.filter(F.col("side") == "train") if "side" in keep else prepared)
    return P.scaler_apply(prepared, fitted), fitted


def first_run(spark, source, artifacts, grids=training.FULL_GRIDS, folds=5, stamp=None, strict=False):
    """Store the data as the first version, profile or validate it, train on it.

    Every later step reads the stored table, so the raw files are scanned once.
    """
    data = writers.Versioned(spark, f"{artifacts}/data")
    staged = data.stage(source)
    stored = spark.read.parquet(staged)
    profile = readers.profile_or_new(spark, stored, f"{artifacts}/profile")
    findings = check(stored, profile, "initial", strict)
    path, found = train_run(spark, stored, artifacts, grids, folds, stamp)
    data.switch(staged)
    return path, found, findings


def train_run(spark, source, artifacts, grids=training.FULL_GRIDS, folds=5, stamp=None):
    """Split by patient, prepare, scale, search, select and save: (path of the model run, metrics).

    The gap fill never crosses patients and the split never cuts one, so the rows are
    prepared once and split afterwards.
    """
    split = group_split(source.filter(F.col(S.KEY).isNotNull()))
    scaled, fitted = prepare_and_scale(split, keep=("side",))
    writers.save_table(scaled, f"{artifacts}/features", by=("side",))
    features = spark.read.parquet(f"{artifacts}/features")
    # train and test rows are searched together, as one balanced set
    train, validation = training.training_sets(features.drop("side"), ROW)
    model, name, found, results = training.train_and_select(train, validation, ROW, grids, folds)
    path = f"{artifacts}/models/model-run-{stamp or datetime.now().strftime('%Y%m%d-%H%M%S')}"
    staged = f"{artifacts}/staged/{uuid.uuid4().hex}"  # a run is visible whole or not at all
    model.write().overwrite().save(f"{staged}/model")
    row = (name, found["accuracy"], found["precision"], found["recall"], found["f1_score"])
    writers.save_json(fitted, f"{staged}/scaler")
    writers.save_json(spark.createDataFrame([row], METRICS), f"{staged}/metrics")
    writers.save_json(results, f"{staged}/grid_results")
    writers.publish(spark, staged, path)
    return path, found


def score_batch(spark, batch, artifacts):
    """(predictions, metrics row, metrics of the saved model): newest model with its scaler."""
    run = readers.latest_run(spark, f"{artifacts}/models")
    model = PipelineModel.load(f"{run['path']}/model")
    scaled, _ = prepare_and_scale(batch, f"{run['path']}/scaler")
    scored = training.predictions(model, scaled)
    found = M.weighted_metrics(scored, S.LABEL, "prediction").first()
    old = readers.json_table(spark, f"{run['path']}/metrics", METRICS).first()
    return scored, found, old


def batch_run(spark, batch, name, artifacts, grids=training.FULL_GRIDS, folds=5, stamp=None, strict=False):
    """Validate and score a batch, merge it into the data, retrain when recall fell too far.

    Merging stages a new version of the data; the pointer moves only after the steps
    on the merged data went through. A scaler belongs to the run of its model.
    """
    profile = readers.profile_or_new(spark, batch, f"{artifacts}/profile")
    batch = materialize(batch)
    findings = check(batch, profile, f"batch/{name}", strict)
    _, found, old = score_batch(spark, batch, artifacts)
    data = writers.Versioned(spark, f"{artifacts}/data")
    existing = data.read()
    staged = data.stage(batch if existing is None else append_batch(existing, batch))
    pair = spark.createDataFrame([(old["recall"], found["recall"])], "old_recall double, new_recall double")
    decision = V.model_drift(pair).first()
    path = None
    if decision["decision"] == "retrain":
        path, _ = train_run(spark, spark.read.parquet(staged), artifacts, grids, folds, stamp)
    data.switch(staged)
    state = V.next_batch(spark.createDataFrame([(name,)], "batch string")).first()
    return {"metrics": found, "decision": decision, "model": path, "findings": findings, "next_batch": state["next_batch"]}


def score_requests(spark, rows, artifacts, model=None):
    """Predictions of parsed request rows, with keys and request columns.

    Rows that keep nulls after the fill, or have no patient, get a null prediction. A model
    that is handed in uses the scaler in the artifacts folder, else both are of the newest run.
    The column anomalies lists what is anomalous in the whole request of the row, as received,
    against the saved profile.
    """
    home = artifacts
    if model is None:
        home = readers.latest_run(spark, f"{artifacts}/models")["path"]
        model = PipelineModel.load(f"{home}/model")
    fitted = readers.json_table(spark, f"{home}/scaler", FITTED)
    carried = [S.KEY, *[c for c in rows.columns if c not in (*S.REQUEST_COLUMNS, "row")]]
    # the same patient in two requests is two groups of the fill
    unit = F.when(F.col(S.KEY).isNotNull(), F.struct("request", S.KEY))
    grouped = rows.withColumn("_unit", unit)
    prepared = P.prepare_features(grouped, key="_unit", order=(S.HOUR, "row"), keep=carried).drop("_unit")
    scored = materialize(training.predictions(model, P.scaler_apply(prepared, fitted)))
    without = rows.join(scored.select("request", "row"), ["request", "row"], "left_anti")
    out = scored.unionByName(without.select(*carried, S.HOUR, "row"), allowMissingColumns=True)
    statistics = readers.json_table(spark, f"{artifacts}/profile/statistics", S.PROFILE_STATS)
    columns = S.numeric_columns(rows.select(*S.REQUEST_COLUMNS))
    found = V.request_anomalies(rows, statistics, columns, request="request")
    # at most one entry for each column
    listed = found.groupBy("request").agg(F.collect_list(F.struct("column_name", "mean_percent", "std_percent")).alias("anomalies"))
    return out.join(listed, "request", "left")


def monitor_requests(logged, profile):
    """Findings of logged request rows against the profile; the label is not expected there."""
    rows = logged.select(*[c for c in S.REQUEST_COLUMNS if c in logged.columns])
    return V.monitor(rows, profile["schema"], profile["statistics"], profile["values"])
