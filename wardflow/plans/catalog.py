"""The registered batch queries: each reads whole tables of a folder and returns a DataFrame."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.functions import scalars as X
from wardflow.operators import cohorts as C
from wardflow.operators import joins as J
from wardflow.operators import metrics as M
from wardflow.operators import ordered as O
from wardflow.operators import prepare as P
from wardflow.operators import profile as R
from wardflow.operators import sampling as G
from wardflow.operators import validate as V
from wardflow.plans.observations import observations, raw_observations, table
from wardflow.session import materialize

KEYS = [S.KEY, S.HOUR]
MEASURED = ["HR", "Temp", "MAP", "BUN", "WBC", "Hct", "AST"]
SCALED = ["HR", "Temp", "MAP", "BUN", "Hct", "WBC"]
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def prepared(spark, folder):
    return P.prepare_features(observations(spark, folder, parts=True).drop("ts"), keep=("event_id",))


def scored(spark, folder):
    """Truth, prediction and score of every observation, by a fixed logistic formula."""
    z = 0.02 * F.coalesce("HR", F.lit(0.0)) + 0.01 * F.coalesce("WBC", F.lit(0.0)) - 1
    o = observations(spark, folder)
    return o.withColumn("score", F.round(1 / (1 + F.exp(-z)), 6)).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


def halves(df):
    """A recorded and a new table: all rows, divided by patient."""
    sides = materialize(G.group_split(df, share=0.5))  # both halves are read several times
    return [sides.filter(F.col("side") == s).drop("side") for s in ("train", "test")]


def file_paths(spark, folder):
    """A path per event: patient files in batch folders, some with another suffix."""
    e = table(spark, folder, "events")
    suffix = F.when(F.col("event_type") == "error", ".txt").otherwise(".psv")
    return e.select(
        "event_id",
        F.concat(
            F.lit("/data/batch-"), (F.col("user_id") % 3 + 1).cast("string"), F.lit("/p"),
            F.lpad(F.col("event_id").cast("string"), 9, "0"), suffix,
        ).alias("path"),
    )


# sources ------------------------------------------------------------------------------


@query
def id_from_path(spark, folder):
    rules = {"file_name": "id_file", "trimmed": "id_trimmed", "after_p": "id_after_p", "stem": "id_stem"}
    return file_paths(spark, folder).select(
        "event_id", *[X.id_from_path("path", rule).alias(name) for rule, name in rules.items()]
    )


@query
def row_position(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "ts")
    numbered = O.row_position(e, "user_id", ["ts", "event_id"])
    return numbered.select("event_id", "user_id", (F.col("position") - 1).alias("Hour"))


@query
def first_rows(spark, folder):
    return observations(spark, folder).select(*KEYS, "HR", S.LABEL).orderBy(*KEYS).limit(1000)


@query
def last_rows(spark, folder):
    o = observations(spark, folder).select(*KEYS, "HR", S.LABEL)
    return o.orderBy(F.col(S.KEY).desc(), F.col(S.HOUR).desc()).limit(1000)


@query
def content_dedup_count(spark, folder):
    return table(spark, folder, "documents").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct(F.md5("text")).alias("n_contents")
    )


@query
def other_files(spark, folder):
    paths = file_paths(spark, folder).filter(~F.col("path").endswith(".psv"))
    return paths.select(
        F.regexp_extract("path", r"^(.*)/", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
    )


@query
def latest_run(spark, folder):
    stamp = F.date_format("ts", "yyyyMMdd-HHmmss")
    path = F.when(
        F.col("event_type") == "signup", F.concat(F.lit("models/model-run-"), stamp, F.lit("/model.pkl"))
    ).otherwise(F.concat(F.lit("models/other-"), stamp))
    runs = table(spark, folder, "events").select(path.alias("path"))
    found = runs.select(X.run_stamp("path").alias("stamp"), X.run_folder("path").alias("run"))
    return found.filter(F.col("stamp").isNotNull()).agg(
        F.max("stamp").alias("stamp"), F.max_by("run", "stamp").alias("run")
    )


@query
def next_version(spark, folder):
    p = table(spark, folder, "part")
    named = p.select(
        F.col("p_brand").alias("prefix"),
        F.when(
            F.col("p_size") % 5 > 0,
            F.concat(F.lit("models/"), "p_brand", F.lit("_20240101_v"), F.col("p_size").cast("string"), F.lit(".pkl")),
        ).otherwise(F.concat(F.lit("models/"), "p_brand", F.lit(".pkl"))).alias("path"),
    )
    return named.groupBy("prefix").agg((F.coalesce(F.max(X.model_version("path")), F.lit(0)) + 1).alias("next_version"))


# projections and scalar functions -----------------------------------------------------


@query
def unit_column(spark, folder):
    return P.add_unit(observations(spark, folder, hours=False)).select("event_id", "Unit")


@query
def pruned_columns(spark, folder):
    return P.drop_sparse(P.drop_redundant(observations(spark, folder).drop("ts")))


@query
def unnamed_dropped(spark, folder):
    o = observations(spark, folder).select("event_id", "HR", S.LABEL)
    return P.drop_unnamed(o.withColumn("Unnamed: 0", F.col("event_id")).withColumn("unnamed_1", F.lit(0)))


@query
def cast_types(spark, folder):
    e = table(spark, folder, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("HR"),
        F.when(F.col("event_id") % 13 == 0, "?").otherwise((F.col("user_id") % 2).cast("string")).alias("Gender"),
        F.when(F.col("event_id") % 7 > 0, F.col("user_id").cast("double")).alias(S.KEY),
    )
    return P.cast_declared(raw)


@query
def inf_nan_to_null(spark, folder):
    kind = F.col("event_id") % 5
    dirty = (
        F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf")).otherwise(F.col("value"))
    )
    e = table(spark, folder, "events").select("event_id", dirty.alias("HR"))
    return P.null_non_finite(e)


@query
def log_columns(spark, folder):
    o = observations(spark, folder)
    return o.select("event_id", *[F.round(X.log1p(F.col(c) - 20), 6).alias(c) for c in ("MAP", "BUN", "WBC")])


@query
def log_clipped(spark, folder):
    o = observations(spark, folder).select("event_id", (F.col("Age") - 40).alias("Age"), S.HOUR, "HospAdmTime")
    return rounded(P.log_time_columns(o), "Age_log", "ICULOS_log", "HospAdmTime_log")


@query
def one_hot_gender(spark, folder):
    return observations(spark, folder, hours=False).select("event_id", X.gender_letter().alias("letter"), *X.one_hot_gender())


@query
def fill_constant(spark, folder):
    o = observations(spark, folder).select("event_id", F.col("AST").alias("TroponinI"), F.col("Hct").alias("Fibrinogen"))
    return P.fill_zero(o)


@query
def null_rendering(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 4 > 0, F.col("user_id")).alias("user_id"),
    )
    return e.select("event_id", X.null_text("event_type").alias("shown"), X.row_json(["event_type", "user_id"]).alias("row"))


@query
def label_encode(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    return J.label_encode(e, "event_type", "code")


@query
def renamed_results(spark, folder):
    names = {"event_type": "model", "value": "Recall"}
    return table(spark, folder, "events").select("event_id", "event_type", "value").withColumnsRenamed(names)


@query
def null_rows_dropped(spark, folder):
    return observations(spark, folder).select(*KEYS, "HR", "WBC").na.drop()


# gap fill, features, scaling ----------------------------------------------------------


@query
def fill_bidirectional(spark, folder):
    o = observations(spark, folder, parts=True)
    filled = O.fill_gaps(o, S.KEY, [S.HOUR], MEASURED)
    return filled.select(*KEYS, *MEASURED)


@query
def fill_forward(spark, folder):
    o = observations(spark, folder, parts=True)
    filled = O.fill_gaps(o, S.KEY, [S.HOUR], MEASURED, direction="forward")
    return filled.select(*KEYS, *MEASURED)


@query
def prepare_features(spark, folder):
    p = prepared(spark, folder)
    return rounded(P.to_feature_order(p, (S.KEY, "event_id", S.LABEL)), "MAP", "BUN", "WBC")


@query
def prepare_all_columns(spark, folder):
    """The same steps on the full raw schema, all thirteen scaled columns."""
    raw = raw_observations(spark, folder)
    p = P.prepare_features(raw, keep=("event_id",))
    return rounded(P.to_feature_order(p, ("event_id",)), *S.SCALED)


@query
def scaler_fit(spark, folder):
    return rounded(P.scaler_fit(prepared(spark, folder), SCALED), "mean", "std")


@query
def scale_apply(spark, folder):
    p = materialize(prepared(spark, folder))  # read by the fit and again by its use
    return rounded(P.scaler_apply(p, P.scaler_fit(p, SCALED), SCALED).select("event_id", *SCALED), *SCALED)


@query
def scaled_by_label(spark, folder):
    p = materialize(prepared(spark, folder))
    s = P.scaler_apply(p, P.scaler_fit(p, SCALED), SCALED)
    return s.groupBy(S.LABEL).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in P.features_in(s)]
    )


@query
def impute_mean(spark, folder):
    """Means of the recorded half fill the gaps of the new one."""
    fit_on, fill = halves(observations(spark, folder))
    filled = P.mean_apply(fill, P.mean_fit(fit_on, MEASURED), MEASURED)
    return rounded(filled.select("event_id", *MEASURED), *MEASURED)


# profile ------------------------------------------------------------------------------


@query
def profile_numeric(spark, folder):
    o = materialize(observations(spark, folder).drop("ts", "event_id"))  # scanned twice
    return rounded(R.profile_numeric(o), "mean", "median", "std")


@query
def profile_text(spark, folder):
    return R.profile_text(table(spark, folder, "documents"), ["lang", "source"])


@query
def profile_values(spark, folder):
    return R.profile_values(table(spark, folder, "documents"), ["lang", "source"])


@query
def recorded_schema(spark, folder):
    """Recorded types with the number of known values behind each column."""
    o = observations(spark, folder).drop("ts", "event_id")
    known = o.agg(*[F.count(c).alias(c) for c in o.columns])
    rows = known.unpivot([], o.columns, "column_name", "known")
    return R.recorded_schema(o).join(rows, "column_name").select("column_name", "dtype", "known")


@query
def table_shape(spark, folder):
    return R.shape(observations(spark, folder).drop("ts", "event_id"))


@query
def missing_counts(spark, folder):
    return R.missing_counts(observations(spark, folder))


@query
def describe_exact(spark, folder):
    li = table(spark, folder, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(R.describe_exact(li, columns), "mean", "std", "q25", "q50", "q75")


@query
def value_counts(spark, folder):
    return R.value_counts(observations(spark, folder, hours=False), "Gender")


@query
def prevalence(spark, folder):
    return rounded(R.prevalence(observations(spark, folder, hours=False)), "prevalence")


@query
def pearson_corr(spark, folder):
    li = table(spark, folder, "lineitem")
    return rounded(R.correlation(li, "l_quantity", "l_extendedprice"), "correlation")


# joins and set operations -------------------------------------------------------------


@query
def outer_count_join(spark, folder):
    return C.label_counts_joined(observations(spark, folder, hours=False).select(S.KEY, S.LABEL))


@query
def label_counts(spark, folder):
    return C.label_counts(observations(spark, folder, hours=False))


@query
def semi_join_cohort(spark, folder):
    o = observations(spark, folder)
    positive = o.filter(F.col(S.LABEL) == 1)
    return J.rows_of(o.select("event_id", *KEYS), positive)


@query
def leakage_check(spark, folder):
    """Patients shared by the two sides of a row-level split."""
    o = observations(spark, folder, hours=False).select("event_id", S.KEY)
    sides = G.row_split(o, "event_id")
    return J.leakage(sides.filter("side = 'train'"), sides.filter("side = 'test'"))


@query
def feature_label_join(spark, folder):
    o = observations(spark, folder)
    return J.with_labels(o.select(*KEYS, "HR"), o.select(*KEYS, S.LABEL))


@query
def anti_join_missing(spark, folder):
    """Customers without an urgent order."""
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    buyers = urgent.select(F.col("o_custkey").alias("c_custkey"))
    return J.absent(table(spark, folder, "customer").select("c_custkey", "c_name"), buyers, "c_custkey")


@query
def distinct_patients(spark, folder):
    return observations(spark, folder, hours=False).select(S.KEY).distinct()


@query
def union_batches(spark, folder):
    first, second = halves(observations(spark, folder).drop("ts"))
    return J.append_batch(first.select("event_id", *KEYS, "HR"), second.select(*KEYS, "HR", "Temp", "event_id"))


@query
def column_symmetric_diff(spark, folder):
    """Names that are only in the expected or only in the given list, per event."""
    e = table(spark, folder, "events")
    given = F.array_compact(
        F.array(
            F.lit("HR"),
            F.when(F.col("event_id") % 2 == 0, "Temp"),
            F.when(F.col("event_id") % 3 == 0, "MAP"),
            F.col("event_type"),
        )
    )
    expected = ["HR", "Temp", "MAP", "view"]
    found = V.request_column_findings(e.select("event_id", given.alias("columns")), expected)
    return found.select("event_id", F.array_join("unexpected", ",").alias("unexpected"))


@query
def distinct_set_diff(spark, folder):
    """Users whose event types differ between early and late events."""
    e = table(spark, folder, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    late = F.col("event_id") % 2 == 1

    def seen(side):
        return F.array_compact(F.array(*[F.max(F.when(side & (F.col("event_type") == k), k)) for k in kinds]))

    sets = e.groupBy("user_id").agg(seen(~late).alias("a"), seen(late).alias("b"))
    return sets.select("user_id", J.sets_differ(F.col("a"), F.col("b")).alias("differ"))


# samples, splits, cohorts -------------------------------------------------------------


@query
def group_split(spark, folder):
    return G.group_split(observations(spark, folder).select(*KEYS))


@query
def row_split(spark, folder):
    return G.row_split(observations(spark, folder, hours=False).select("event_id", S.LABEL), "event_id")


@query
def undersample_2to1(spark, folder):
    return G.undersample(observations(spark, folder).select("event_id", *KEYS, S.LABEL), "event_id")


@query
def stratified_sample(spark, folder):
    """A quarter of the rows, class shares kept."""
    o = observations(spark, folder, hours=False).select("event_id", S.LABEL)
    return G.stratified_sample(o, "event_id", lambda n: F.floor(n * F.lit(0.25)))


@query
def kfold_assignment(spark, folder):
    return G.assign_folds(observations(spark, folder, hours=False).select("event_id", S.LABEL), "event_id")


@query
def kfold_sizes(spark, folder):
    folds = kfold_assignment(spark, folder)
    return folds.groupBy(S.LABEL, "fold").agg(F.count(F.lit(1)).alias("n"))


@query
def running_positives(spark, folder):
    return C.running_positives(C.label_counts(observations(spark, folder, hours=False)))


@query
def cohort_by_threshold(spark, folder):
    cohorts = C.threshold_cohorts(C.label_counts(observations(spark, folder, hours=False)))
    return cohorts.select(S.KEY, "count_of_1", "cohort")


@query
def cohort_batches(spark, folder):
    """The middle cohort's rows in three parts."""
    o = observations(spark, folder)
    middle = C.threshold_cohorts(C.label_counts(o)).filter("cohort = 2")
    return G.equal_parts(J.rows_of(o.select("event_id", S.KEY), middle), "event_id")


@query
def ntile_batches(spark, folder):
    return G.equal_parts(observations(spark, folder, hours=False).select("event_id"), "event_id")


@query
def chunk_500(spark, folder):
    return C.chunks(table(spark, folder, "events").select("event_id"), ["event_id"])


@query
def ordered_quota(spark, folder):
    """The first 24 patients, and whether they are among the first 18 or the last 6."""
    named = C.quota_names(observations(spark, folder, hours=False), S.KEY, [("train", 18), ("test", 6)], "unused")
    return named.filter("destination <> 'unused'").select(S.KEY, "destination")


@query
def quota_distribution(spark, folder):
    quotas = [("initial", 60), ("batch-1", 12), ("batch-2", 12), ("batch-3", 12)]
    return C.quota_names(observations(spark, folder, hours=False), S.KEY, quotas, "client").select(S.KEY, "destination")


# validation and control decisions -----------------------------------------------------


def expected_schema(spark):
    rows = [(i, f.name, S.dtype_name(f.dataType)) for i, f in enumerate(S.OBSERVATIONS)]
    return spark.createDataFrame(rows, "position int, column_name string, dtype string")


@query
def schema_findings(spark, folder):
    """The observation table, with one type changed, against the recorded schema."""
    o = observations(spark, folder).drop("ts", "event_id")
    changed = o.withColumn("Gender", F.col("Gender").cast("double")).withColumn("Age", F.col("Age").cast("string"))
    found = V.schema_findings(R.recorded_schema(changed), expected_schema(spark))
    return found.withColumn("n_rows", changed.agg(F.count(F.lit(1))).scalar())


@query
def stat_findings(spark, folder):
    """The new half, with shifted values, against the profile of the recorded one."""
    base, new = halves(observations(spark, folder).drop("ts", "event_id"))
    shifted = new.withColumns({"Temp": F.col("Temp") + 200, "BUN": F.col("BUN") - 5})
    columns = [*MEASURED, "Age", "HospAdmTime"]
    found = V.stat_findings(R.profile_numeric(shifted, columns), R.profile_numeric(base, columns))
    return rounded(found, "expected", "observed")


@query
def null_rate_findings(spark, folder):
    base, new = halves(observations(spark, folder).drop("ts", "event_id"))
    found = V.stat_findings(R.profile_numeric(new, MEASURED), R.profile_numeric(base, MEASURED), rates=True)
    return rounded(found.filter("rule = 'null_rate'"), "expected", "observed")


@query
def value_findings(spark, folder):
    """Languages and sources of a new part of the documents, with one renamed, against the rest."""
    d = G.row_split(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id", 0.5)
    new = d.filter("side = 'test'").withColumn("lang", F.when(F.col("lang") == "en", "xx").otherwise(F.col("lang")))
    columns = ["lang", "source"]
    return V.value_findings(R.profile_values(new, columns), R.profile_values(d.filter("side = 'train'"), columns))


@query
def null_key_findings(spark, folder):
    o = observations(spark, folder).select(F.when(F.col("event_id") % 100 > 0, F.col(S.KEY)).alias(S.KEY))
    return V.null_key_findings(o)


@query
def request_anomaly(spark, folder):
    """Signups of every event as one request against the profile of the other events."""
    e = table(spark, folder, "events")
    z = F.col("value")

    def shape(side, by):
        return side.select(
            (z * by).alias("HR"), (z - 25).alias("Temp"), (-z).alias("HospAdmTime"), F.lit(5.0).alias("Age")
        )

    recorded = R.profile_numeric(shape(e.filter("event_type <> 'signup'"), 1))
    request = shape(e.filter("event_type = 'signup'"), 9)
    found = V.request_anomalies(request, recorded, ["HR", "Temp", "HospAdmTime", "Age"])
    return rounded(found, "mean_percent", "std_percent")


@query
def request_anomaly_by_request(spark, folder):
    """All events of each user as one request, every third in another unit, against the profile of all."""
    e = table(spark, folder, "events")
    z, by = F.col("value"), F.when(F.col("user_id") % 3 == 0, 9).otherwise(1)

    def shape(by):
        return e.select(
            F.col("user_id").cast("string").alias("request"),
            (z * by).alias("HR"), (z - 25).alias("Temp"), (-z).alias("HospAdmTime"), F.lit(5.0).alias("Age"),
        )

    columns = ["HR", "Temp", "HospAdmTime", "Age"]
    recorded = R.profile_numeric(shape(F.lit(1)), columns)
    return rounded(V.request_anomalies(shape(by), recorded, columns, request="request"), "mean_percent", "std_percent")


@query
def model_drift_decision(spark, folder):
    """Weighted recall by gender, recorded against new patients."""
    s = G.group_split(scored(spark, folder), share=0.5)
    recorded = F.col("side") == "train"
    hit = (F.col(S.LABEL) == F.col("prediction")).cast("double")
    recalls = s.groupBy("Gender").agg(
        F.round(F.avg(F.when(recorded, hit)), 6).alias("old_recall"), F.round(F.avg(F.when(~recorded, hit)), 6).alias("new_recall")
    )
    return rounded(V.model_drift(recalls), "recall_change")


def all_numeric(df):
    """The numeric columns of observations, without the label."""
    return S.numeric_columns(df, skip=(S.KEY, S.LABEL, "event_id"))


@query
def next_step(spark, folder):
    """What follows from the findings in a new half in which some rows have lost their patient."""
    base, new = halves(observations(spark, folder).drop("ts"))
    columns = all_numeric(base)
    lost = new.select(F.when(F.col("event_id") % 100 > 0, F.col(S.KEY)).alias(S.KEY))
    findings = V.all_findings(
        V.stat_findings(R.profile_numeric(new, columns), R.profile_numeric(base, columns)),
        V.null_key_findings(lost),
    )
    return V.next_action(findings, "data/batch-1/observations")


@query
def next_batch(spark, folder):
    names = table(spark, folder, "events").select(
        F.concat(F.lit("batch-"), (F.col("user_id") % 5 + 1).cast("string")).alias("batch")
    )
    return V.next_batch(names.distinct())


@query
def alert_text(spark, folder):
    base, new = halves(observations(spark, folder).drop("ts"))
    columns = all_numeric(base)
    return V.alert_text(V.stat_findings(R.profile_numeric(new, columns), R.profile_numeric(base, columns)), "monitor")


# metrics ------------------------------------------------------------------------------


def quality_pairs(spark, folder):
    return table(spark, folder, "labels")


@query
def confusion_matrix(spark, folder):
    return M.confusion_matrix(quality_pairs(spark, folder), "quality", "toxic")


@query
def accuracy(spark, folder):
    return rounded(M.accuracy(scored(spark, folder), S.LABEL, "prediction"), "accuracy")


@query
def weighted_metrics(spark, folder):
    m = M.weighted_metrics(quality_pairs(spark, folder), "quality", "toxic")
    return rounded(m, *m.columns)


@query
def binary_f1(spark, folder):
    m = M.binary_metrics(scored(spark, folder), S.LABEL, "prediction")
    return rounded(m, *m.columns)


@query
def classification_report(spark, folder):
    r = M.classification_report(scored(spark, folder), S.LABEL, "prediction")
    return rounded(r, "precision", "recall", "f1_score")


@query
def roc_points(spark, folder):
    return rounded(M.roc_points(scored(spark, folder), S.LABEL, "score"), "fpr", "tpr")


@query
def roc_auc(spark, folder):
    return rounded(M.roc_auc(scored(spark, folder), S.LABEL, "score"), "auc")


@query
def patient_verdict(spark, folder):
    return M.patient_verdict(scored(spark, folder))


def requests_log(spark, folder):
    """Each user's events of one type as one request."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    named = e.withColumn("request", F.concat_ws("-", "user_id", "event_type"))
    return M.scoring_log(named, "request", "value", "ts")


@query
def scoring_log(spark, folder):
    return rounded(requests_log(spark, folder), "total_latency", "average_latency_per_row")


@query
def latency_summary(spark, folder):
    m = M.latency_summary(requests_log(spark, folder))
    return rounded(m, "total_latency", "max_latency", "average_latency_per_row")


def grid_results(spark, folder):
    """A grid of settings taken from the event numbers, the value as the score."""
    e = table(spark, folder, "events")
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("model-"), "event_type").alias("model"),
        F.element_at(F.array(F.lit(50), F.lit(100), F.lit(200)), (n % 3 + 1).cast("int")).alias("n_estimators"),
        F.element_at(F.array(F.lit(3), F.lit(6), F.lit(9)), (F.floor(n / 3) % 3 + 1).cast("int")).alias("max_depth"),
        F.element_at(F.array(F.lit("0.01"), F.lit("0.1"), F.lit("0.2")), (F.floor(n / 9) % 3 + 1).cast("int")).alias("learning_rate"),
        (F.col("value") / 1000).alias("score"),
    )


@query
def grid_pivot(spark, folder):
    wide = M.grid_pivot(
        grid_results(spark, folder), "n_estimators", "learning_rate", ["0.01", "0.1", "0.2"], "score", "max_depth"
    )
    named = wide.withColumnsRenamed({"0.01": "rate_001", "0.1": "rate_01", "0.2": "rate_02"})
    return rounded(named, "rate_001", "rate_01", "rate_02")


@query
def best_candidate(spark, folder):
    means = grid_results(spark, folder).groupBy("model").agg(F.round(F.avg("score"), 6).alias("score"))
    return M.best_candidate(means, "model", "score")


@query
def prediction_histogram(spark, folder):
    return rounded(R.histogram(scored(spark, folder), "score"), "lower")


COEFFICIENTS = {"HR": 0.5, "Temp": -0.25, "MAP": 1.5, "WBC": 2.0}


@query
def linear_contributions(spark, folder):
    c = M.linear_contributions(materialize(prepared(spark, folder)), COEFFICIENTS, ["event_id"])
    return rounded(c, *COEFFICIENTS)


@query
def mean_abs_contribution(spark, folder):
    c = M.linear_contributions(materialize(prepared(spark, folder)), COEFFICIENTS, ["event_id"])
    return rounded(M.mean_abs_contribution(c, list(COEFFICIENTS)), "importance")
