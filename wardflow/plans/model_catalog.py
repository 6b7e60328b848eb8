"""Registered queries that train, score, parse requests or stream. They read whole tables too."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators import cohorts as C
from wardflow.operators import joins as J
from wardflow.operators import metrics as M
from wardflow.operators import prepare as P
from wardflow.operators import profile as R
from wardflow.operators import sampling as G
from wardflow.operators.ordered import drop_parts
from wardflow.plans import jobs, training
from wardflow.plans.catalog import QUERIES, query, requests_log, rounded
from wardflow.plans.observations import observations, raw_observations, table
from wardflow.session import materialize, new_folder
from wardflow.sources import readers, writers
from wardflow.sources.requests import as_request, parse_requests
from wardflow.streaming import streams

#: The largest forest and boosting of the full grids, and a tree without a depth limit.
FIXED = {
    "Random_Forest_Classifier": {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 5},
    "Gradient_Boosted_Trees": {"maxIter": 200, "maxDepth": 9, "stepSize": 0.1},
    "Logistic_Regression": {"regParam": 0.01},
    "Decision_Tree": {"maxDepth": 30, "minInstancesPerNode": 2},
}


def sets(spark, folder):
    """Balanced training and validation rows of the scaled observation features."""
    p = materialize(P.prepare_features(observations(spark, folder, parts=True).drop("ts"), keep=("event_id",)))
    scaled = P.scaler_apply(p, P.scaler_fit(p))
    return training.training_sets(scaled, "event_id")


def fitted_metrics(spark, folder, name):
    train, validation = sets(spark, folder)
    model = training.fit(train, name, FIXED[name])
    m = M.weighted_metrics(training.predictions(model, validation), S.LABEL, "prediction")
    return rounded(m.withColumn("model", F.lit(name)), "accuracy", "precision", "recall", "f1_score")


@query
def train_lr(spark, folder):
    return fitted_metrics(spark, folder, "Logistic_Regression")


@query
def train_rf(spark, folder):
    return fitted_metrics(spark, folder, "Random_Forest_Classifier")


@query
def train_gbt(spark, folder):
    return fitted_metrics(spark, folder, "Gradient_Boosted_Trees")


@query
def train_dt(spark, folder):
    return fitted_metrics(spark, folder, "Decision_Tree")


def searched(spark, folder, name):
    """Every setting of one family's full grid with its score over five folds."""
    train, _ = sets(spark, folder)
    return training.grid_search(train, name, training.FULL_GRIDS[name], "event_id", folds=5)[1]


@query
def grid_search_results(spark, folder):
    return searched(spark, folder, "Logistic_Regression")


@query
def grid_search_rf(spark, folder):
    return searched(spark, folder, "Random_Forest_Classifier")


@query
def grid_search_gbt(spark, folder):
    return searched(spark, folder, "Gradient_Boosted_Trees")


@query
def grid_search_dt(spark, folder):
    return searched(spark, folder, "Decision_Tree")


@query
def model_selection(spark, folder):
    """The winner of all four families, each searched over its full grid with five folds."""
    train, validation = sets(spark, folder)
    _, best, found, _ = training.train_and_select(train, validation, "event_id", training.FULL_GRIDS, folds=5)
    return spark.createDataFrame([(best, found["accuracy"], found["f1_score"])], "model string, accuracy double, f1_score double")


@query
def feature_importance(spark, folder):
    train, _ = sets(spark, folder)
    model = training.fit(train, "Random_Forest_Classifier", FIXED["Random_Forest_Classifier"])
    return training.feature_importance(spark, model, P.features_in(train))


@query
def class_probability(spark, folder):
    train, validation = sets(spark, folder)
    scored = training.predictions(training.fit(train, "Logistic_Regression"), validation)
    return rounded(scored.select("event_id", S.LABEL, "prediction", "score"), "score")


@query
def batch_score(spark, folder):
    """Scaler and model fitted on one half of the patients, saved, and used on the other half."""
    o = observations(spark, folder).drop("ts")
    halves = G.group_split(o, share=0.5)
    artifacts = new_folder(spark, "batch-score")
    train, fitted = jobs.prepare_and_scale(halves.filter("side = 'train'").drop("side"), keep=("event_id",))
    writers.save_json(fitted, f"{artifacts}/scaler")
    model = training.fit(G.undersample(train, "event_id"), "Logistic_Regression")
    model.write().overwrite().save(f"{artifacts}/model")
    rows, _ = jobs.prepare_and_scale(halves.filter("side = 'test'").drop("side"), f"{artifacts}/scaler", keep=("event_id",))
    scored = training.predictions(PipelineModel.load(f"{artifacts}/model"), rows)
    return scored.select("event_id", S.KEY, S.HOUR, S.LABEL, "prediction")


@query
def batch_score_rows(spark, folder):
    """Keys and labels of the rows that batch_score scores, and whether each has a prediction."""
    scored = batch_score(spark, folder)
    return scored.select("event_id", S.KEY, S.LABEL, F.coalesce(F.col("prediction").isin(0, 1), F.lit(False)).alias("predicted"))


@query
def batch_retrain(spark, folder):
    """Rows of the stored data after a first run, after a drifted batch, and after going back.

    A fifth of the patients is the batch. It has its labels turned round, so recall falls and
    the model is trained again.
    """
    raw = drop_parts(raw_observations(spark, folder)).drop("event_id")
    base, batch = (G.group_split(raw, share=0.2).filter(f"side = '{s}'").drop("side") for s in ("train", "test"))
    home, name = new_folder(spark, "retrain"), "Logistic_Regression"
    grids = {name: training.FULL_GRIDS[name]}
    jobs.first_run(spark, base, home, grids, stamp="20240101-000000")
    data = writers.Versioned(spark, f"{home}/data")
    steps = [data.read().withColumn("step", F.lit("first run"))]
    out = jobs.batch_run(spark, batch.withColumn(S.LABEL, 1 - F.col(S.LABEL)), "batch-1", home, grids, stamp="20240102-000000")
    newest = readers.latest_run(spark, f"{home}/models")["run"]
    merged = f"{out['decision']['decision']}, {newest}, then {out['next_batch']}"
    steps.append(data.read().withColumn("step", F.lit(merged)))
    data.revert()
    steps.append(data.read().withColumn("step", F.lit("reverted")))
    counts = [s.groupBy("step").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.LABEL).alias("positives")) for s in steps]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def model_contributions(spark, folder):
    """Whether the contributions in a saved linear model add up to the margin of each row."""
    train, _ = sets(spark, folder)
    path = f"{new_folder(spark, 'linear')}/model"
    training.fit(train, "Logistic_Regression").write().overwrite().save(path)
    model, names = PipelineModel.load(path), P.features_in(train)
    weights = training.coefficients(model, names)
    means = train.agg(*[F.avg(c).alias(c) for c in names]).first()
    base = model.stages[-1].intercept + sum(weights[c] * means[c] for c in names)
    parts = M.linear_contributions(train, weights, ["event_id"])
    margin = model.transform(train).select("event_id", vector_to_array("rawPrediction")[1].alias("margin"))
    total = sum((F.col(c) for c in names), F.lit(base))
    same = F.abs(total - F.col("margin")) <= 1e-9 * (1 + F.abs(F.col("margin")))
    return parts.join(margin, "event_id").select("event_id", same.alias("adds_up"))


def request_lines(spark, folder):
    """The raw observations of each patient as one JSON request."""
    raw = drop_parts(raw_observations(spark, folder))
    rows = raw.withColumns({"request": F.col(S.KEY), "row": F.col(S.HOUR) - 1})
    return as_request(rows, S.REQUEST_COLUMNS)


@query
def request_parse(spark, folder):
    rows, _ = parse_requests(request_lines(spark, folder))
    return rows.select(*S.REQUEST_COLUMNS)


@query
def request_rejects(spark, folder):
    """Requests made of documents, all refused, with the reason."""
    d = table(spark, folder, "documents")
    body = (
        F.when(F.col("doc_id") % 4 == 0, "{}")
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.array("text").alias("columns"))))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.array(F.array("text")).alias("data"))))
        .otherwise(F.to_json(F.struct(F.array(F.array("text")).alias("data"), F.array(*map(F.lit, S.REQUEST_COLUMNS)).alias("columns"))))
    )
    _, rejects = parse_requests(d.select(F.col("doc_id").alias("request"), body.alias("value")))
    return rejects


@query
def profile_saved(spark, folder):
    """A profile written to a folder and read back."""
    d = table(spark, folder, "lineitem")
    return rounded(
        readers.profile_or_new(spark, d, new_folder(spark, "profile"))["statistics"], "mean", "median", "std"
    )


@query
def versioned_merge(spark, folder):
    """Two batches merged into a versioned table, the second merge taken back."""
    base, batch = [G.group_split(observations(spark, folder).drop("ts"), share=0.5).filter(f"side = '{s}'") for s in ("train", "test")]
    data = writers.Versioned(spark, new_folder(spark, "versions"))
    data.switch(data.stage(base))
    data.switch(data.stage(data.read().unionByName(batch)))
    merged = data.read().groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit("merged"))
    data.revert()
    before = data.read().groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit("reverted"))
    return merged.unionByName(before)


@query
def merged_csv(spark, folder):
    """The raw observations exported as CSV with a header and read back by the declared schema."""
    path = f"{new_folder(spark, 'merged')}/observations.csv"
    writers.save_csv(drop_parts(raw_observations(spark, folder)).select(*S.OBSERVATIONS.names), path)
    back = readers.observation_table(spark, path)
    return back.select(*S.OBSERVATIONS.names)


def delimited_files(spark, folder):
    """The raw observations as delimited files with a header, below batch and patient.

    A patient has one file for each ten thousand hours. One record in a hundred is torn, and as
    many have a word in place of the first number, or a field too many.
    """
    raw = drop_parts(raw_observations(spark, folder))
    names, at = S.RAW_FILE.names, F.col("event_id") % 100
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in names]
    line = F.concat_ws("|", *cells)
    line = (
        F.when(at == 0, F.concat_ws("|", F.col("event_id").cast("string"), F.lit("torn")))
        .when(at == 50, F.concat_ws("|", F.lit("high"), *cells[1:]))
        .when(at == 75, F.concat_ws("|", line, F.lit("extra")))
        .otherwise(line)
    )
    batch, part = F.substring(S.KEY, 2, 20).cast("bigint") % 3, F.floor(F.col(S.HOUR) / 10_000)
    rows = raw.select(batch.alias("batch"), S.KEY, part.alias("part"), F.col(S.HOUR).alias("at"), line.alias("value"))
    place = ["batch", S.KEY, "part"]
    heads = rows.select(*place).distinct().withColumns({"at": F.lit(0).cast("bigint"), "value": F.lit("|".join(names))})
    path = f"{new_folder(spark, 'delimited')}/files"
    sorted_ = rows.unionByName(heads).repartition(*place).sortWithinPartitions(*place, "at")
    sorted_.select(*place, "value").write.partitionBy(*place).text(path)
    return path


@query
def delimited_ingest(spark, folder):
    """All columns of the accepted records of all batches of delimited files."""
    return readers.ingest_files(spark, delimited_files(spark, folder), id_rule="folder", name_glob="*.txt")[0]


@query
def delimited_batch(spark, folder):
    """The accepted records of one batch, picked by its folder."""
    path = f"{delimited_files(spark, folder)}/batch=1"
    return readers.ingest_files(spark, path, id_rule="folder", name_glob="*.txt")[0]


@query
def delimited_rejects(spark, folder):
    """Refused records of each patient by their number of fields."""
    _, rejects = readers.ingest_files(spark, delimited_files(spark, folder), id_rule="folder", name_glob="*.txt")
    fields = F.size(F.split("record", r"\|")).cast("bigint")
    return rejects.groupBy(S.KEY, fields.alias("n_fields")).agg(F.count(F.lit(1)).alias("n"))


@query
def cohort_files(spark, folder):
    """Cohorts written as delimited files, one folder each, and counted after reading."""
    o = observations(spark, folder)
    cohorts = C.threshold_cohorts(C.label_counts(o)).select(S.KEY, "cohort")
    path = f"{new_folder(spark, 'cohorts')}/files"
    rows = o.select("event_id", S.KEY).join(cohorts, S.KEY)
    writers.save_csv(rows.select("event_id", S.KEY, "cohort"), path, "|", ["cohort"])
    back = spark.read.schema("event_id bigint, Patient_ID string, cohort int").option("header", True).option("sep", "|").csv(path)
    return back.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(S.KEY).alias("patients"))


@query
def appended_log(spark, folder):
    """The scoring log written in two appends, halved by request, and read back."""
    log = requests_log(spark, folder)
    path = f"{new_folder(spark, 'log')}/rows"
    sides = G.group_split(log, "request", 0.5)
    for side in ("train", "test"):
        writers.append_log(sides.filter(F.col("side") == side).drop("side"), path)
    back = writers.read_log(spark, path)
    return rounded(back.select("request", "n_input_rows", "total_latency"), "total_latency")


@query
def patient_split_training(spark, folder):
    """Patients shared by training and validation rows when whole patients are split."""
    p = P.prepare_features(observations(spark, folder, parts=True).drop("ts"), keep=("event_id",))
    train, validation = training.training_sets(p, "event_id", by_patient=True)
    return J.leakage(train, validation)


@query
def patient_split_rows(spark, folder):
    """Balanced rows with the side that their whole patient went to."""
    p = P.prepare_features(observations(spark, folder, parts=True).drop("ts"), keep=("event_id",))
    split = training.training_sets(p, "event_id", by_patient=True)
    train, validation = (rows.select("event_id", S.KEY, S.LABEL, F.lit(side).alias("side")) for rows, side in zip(split, ("train", "test")))
    return train.unionByName(validation)


# streams ------------------------------------------------------------------------------


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    # a pattern for just this name, because a stream takes one file by a pattern only
    return streams.file_stream(spark, f"{folder}/events.parque[t]", schema, "parquet")


@query
def stream_ingest(spark, folder):
    out = new_folder(spark, "ingest")
    streams.ingest(event_stream(spark, folder), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


@query
def stream_latency_window(spark, folder):
    """Latency per day over the events as a log; the last, still open window is not emitted."""
    log = event_stream(spark, folder).select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(1).cast("bigint").alias("n_input_rows"), F.col("value").alias("total_latency")
    )
    out = new_folder(spark, "windows")
    streams.run_windows(streams.latency_windows(log, "1 day"), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/rows")
    return rounded(
        rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "requests", "rows", "total_latency", "max_latency"),
        "total_latency", "max_latency",
    )


def drift_input(events):
    """Events as observations of users; every hundredth has lost its user."""
    lost = F.when(F.col("event_id") % 100 > 0, F.col("user_id").cast("string"))
    return events.withColumn(S.KEY, lost)


def drift_found(spark, folder, stream):
    """Findings in a whole stream of events against the profile of the error events, all columns."""
    errors = drift_input(table(spark, folder, "events")).filter("event_type = 'error'")
    profile = {
        "schema": R.recorded_schema(errors),
        "statistics": materialize(R.profile_numeric(errors)),
        "values": materialize(R.profile_values(errors, ["event_type", "props"])),
    }
    out = new_folder(spark, "drift")
    streams.drift_stream(drift_input(stream), profile, out, f"{out}/checkpoint")
    return streams.drift_so_far(spark, out).select("rule", "column_name", "severity", "expected", "observed")


@query
def stream_drift(spark, folder):
    """Findings in the events, read as one micro-batch."""
    return drift_found(spark, folder, event_stream(spark, folder))


@query
def stream_drift_files(spark, folder):
    """Findings in the events, which arrive in seven files, each a micro-batch."""
    events, landing = table(spark, folder, "events"), f"{new_folder(spark, 'landing')}/events"
    writers.save_table(events.repartition(7, "event_id"), landing)
    return drift_found(spark, folder, streams.file_stream(spark, landing, events.schema, "parquet", files_per_batch=1))


def scored_requests(spark, folder, lines):
    """Folder with what score_stream makes of the lines, with a model fitted on the raw observations."""
    raw = raw_observations(spark, folder)
    out = new_folder(spark, "score")
    scaled, fitted = jobs.prepare_and_scale(raw, keep=("event_id",))
    writers.save_json(fitted, f"{out}/scaler")
    readers.profile_or_new(spark, drop_parts(raw).drop("event_id"), f"{out}/profile")
    model = training.fit(G.undersample(scaled, "event_id"), "Logistic_Regression")
    writers.save_table(lines.withColumn("arrived", F.current_timestamp()), f"{out}/lines")
    stream = streams.file_stream(spark, f"{out}/lines", spark.read.parquet(f"{out}/lines").schema, "parquet")
    streams.score_stream(stream, lambda rows: jobs.score_requests(spark, rows, out, model), f"{out}/out", f"{out}/checkpoint")
    return f"{out}/out"


@query
def stream_score(spark, folder):
    """Request lines stream in, are scored with a fitted model, and are logged."""
    out = scored_requests(spark, folder, request_lines(spark, folder))
    return spark.read.parquet(f"{out}/log").select("request", "n_input_rows")


@query
def stream_outcomes(spark, folder):
    """Rows with and without a prediction of every request of a stream, and refused requests.

    The requests of every tenth patient come without names of columns.
    """
    whole = F.substring(S.KEY, 2, 20).cast("bigint") % 10 > 0
    lines = request_lines(spark, folder).withColumn(S.KEY, F.col("request"))
    body = F.when(whole, F.col("value")).otherwise(F.replace("value", F.lit('"columns"'), F.lit('"names"')))
    out = scored_requests(spark, folder, lines.withColumn("value", body).drop(S.KEY))
    scored = spark.read.parquet(f"{out}/scored").groupBy("request").agg(
        F.lit("accepted").alias("outcome"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("prediction").isin(0, 1)).alias("n_predicted"),
        F.count_if(F.col("prediction").isNull()).alias("n_not_predicted"),
    )
    none = [F.lit(0).cast("bigint").alias(c) for c in ("n_rows", "n_predicted", "n_not_predicted")]
    return scored.unionByName(spark.read.parquet(f"{out}/rejects").select("request", F.col("reason").alias("outcome"), *none))


def logged_requests(spark, lines):
    """Request lines streamed in batches of one file each; the log of their rows as received."""
    out = new_folder(spark, "requests")
    writers.save_table(lines.withColumn("arrived", F.current_timestamp()).repartition(4, "request"), f"{out}/lines")
    stream = streams.file_stream(spark, f"{out}/lines", spark.read.parquet(f"{out}/lines").schema, "parquet", files_per_batch=1)
    none = F.lit(None).cast("int").alias("prediction")
    streams.score_stream(stream, lambda rows: rows.select("request", "row", "arrived", none), f"{out}/out", f"{out}/checkpoint")
    return streams.request_log(spark, f"{out}/out")


@query
def request_log(spark, folder):
    """Logged request rows, after a batch came twice and an attempt was left unfinished."""
    log = logged_requests(spark, request_lines(spark, folder))
    again = materialize(log.read().filter("batch = 0").drop("batch"))
    log.append(again, 0)
    again.write.parquet(f"{log.folder}/rows/batch=0/attempt=a-unfinished")
    return log.read().select(*S.REQUEST_COLUMNS)


@query
def request_log_monitor(spark, folder):
    """Findings in the logged requests of one half of the patients against the other half's profile."""
    halves = G.group_split(drop_parts(raw_observations(spark, folder)), share=0.5)
    base, new = (halves.filter(F.col("side") == s).drop("side") for s in ("train", "test"))
    recorded = base.select(*S.REQUEST_COLUMNS)
    profile = {
        "schema": R.recorded_schema(recorded),
        "statistics": R.profile_numeric(recorded, S.numeric_columns(recorded)),
        "values": R.profile_values(recorded, []),
    }
    rows = new.withColumns({"request": F.col(S.KEY), "row": F.col(S.HOUR) - 1})
    log = logged_requests(spark, as_request(rows, S.REQUEST_COLUMNS))
    found = jobs.monitor_requests(log.read(), profile)
    return rounded(found.withColumn("expected", F.col("expected").cast("double")), "expected").select("rule", "column_name", "severity", "expected")


MODEL_QUERIES = [n for n, f in QUERIES.items() if f.__module__ == __name__]
