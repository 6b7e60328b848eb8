"""Model training, grid search and selection with pyspark.ml."""

import time
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators import metrics as M
from wardflow.operators.prepare import features_in
from wardflow.operators.sampling import assign_folds, group_split, row_split, undersample
from wardflow.plans import ensembles as E
from wardflow.session import checkpoint_folder, checkpointed, materialize
from wardflow.sources.writers import exists

# The names of the families and the parameter grids of the full search. A tree depth of 30 stands for
# no limit (the most Spark allows); rows per leaf stand in for rows per split.
FULL_GRIDS = {
    "Random_Forest_Classifier": {"numTrees": [50, 100], "maxDepth": [10, 20], "minInstancesPerNode": [5, 7]},
    "Gradient_Boosted_Trees": {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2]},
    "Logistic_Regression": {"C": [0.1, 1.0, 10.0]},
    "Decision_Tree": {"maxDepth": [30, 10, 20], "minInstancesPerNode": [2, 5, 10]},
}

# Deep trees keep the node that each row has reached; otherwise every level takes each row from the root again,
# through trees that travel with the tasks. The trees are the same. Shallow boosted trees gain nothing by it; tasks of
# boosting carry the trees of all rounds since the last checkpoint instead, so few rounds lie between two.
ESTIMATORS = {
    "Random_Forest_Classifier": lambda seed: RandomForestClassifier(seed=seed, cacheNodeIds=True),
    "Gradient_Boosted_Trees": lambda seed: GBTClassifier(seed=seed, checkpointInterval=3),
    "Logistic_Regression": lambda seed: LogisticRegression(maxIter=200, elasticNetParam=0.0, standardization=False),
    "Decision_Tree": lambda seed: DecisionTreeClassifier(seed=seed, cacheNodeIds=True),
}


def evaluator(score="f1", label=S.LABEL):
    """f1 of the positive class, weighted f1 or recall, or area under the ROC curve."""
    if score == "roc_auc":
        return BinaryClassificationEvaluator(labelCol=label)
    kinds = {"f1": "fMeasureByLabel", "weighted_f1": "f1", "weighted_recall": "weightedRecall"}
    return MulticlassClassificationEvaluator(labelCol=label, metricName=kinds[score], metricLabel=1.0)


def training_sets(prepared, key, seed="42", share=0.2, by_patient=False):
    """(train, validation): two negatives per positive, then a row split or one by patient.

    The row split may put hours of one patient on both sides; by_patient prevents it.
    """
    balanced = materialize(undersample(prepared, key))
    if by_patient:
        sides = group_split(balanced, S.KEY, share, seed)
    else:
        sides = row_split(balanced, key, share, seed)
    return [sides.filter(F.col("side") == s).drop("side") for s in ("train", "test")]


def settings_of(grid, n):
    """Every combination of the grid, in order; C of n training rows becomes the penalty 1 / (C * n)."""
    out = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        if "C" in setting:
            setting["regParam"] = 1.0 / (setting.pop("C") * n)
        out.append(setting)
    return out


#: Rows of a task of a search or of boosting: smaller tables are read in fewer tasks, as each
#: level of a tree is a job of its own. A task of boosting has at most MOST_ROWS, however few the cores.
ROWS_OF_A_TASK, MOST_ROWS = 20_000, 1_000_000


def dealt(rows):
    """rows in as many tasks as their number and the cores call for, cut off from their plan.

    Every task of boosting's many short jobs unpacks that plan and the latest trees, which takes
    longer than a level of a few thousand rows.
    """
    rows = materialize(rows)
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return checkpointed(rows.coalesce(max(1, min(cores, -(-n // ROWS_OF_A_TASK)), -(-n // MOST_ROWS))))


def fit(train, name, params=None, label=S.LABEL, seed=42):
    """One model with fixed parameters, as a pipeline from feature columns to predictions."""
    estimator = ESTIMATORS[name](seed).setLabelCol(label)
    for p, v in (params or {}).items():
        estimator = estimator.copy({estimator.getParam(p): v})
    assembler = VectorAssembler(inputCols=features_in(train), outputCol="features")
    checkpoint_folder(train.sparkSession)  # where kept nodes and boosting cut their lineage
    if isinstance(estimator, GBTClassifier):
        rows = dealt(assembler.transform(train).select("features", label))
        return PipelineModel([assembler, estimator.fit(rows)])
    if isinstance(estimator, RandomForestClassifier) and not E.surely_small(estimator, train.count()):
        rows = materialize(assembler.transform(train).select("features", label))
        return PipelineModel([assembler, E.fitted(estimator, E.Rows(rows, label, len(assembler.getInputCols())))])
    return Pipeline(stages=[assembler, estimator]).fit(train)


def _with(estimator, setting):
    return estimator.copy({estimator.getParam(p): v for p, v in setting.items()})


def shortened(model, rounds):
    """The model that boosting would have stopped at after fewer rounds: its first trees.

    Without row or feature samples a round depends on the rounds before it alone, so the
    first trees of a long fit are the trees of a short one.
    """
    java, context = model._java_obj, SparkContext._active_spark_context
    kind = context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = context._gateway.new_array(kind, rounds), context._gateway.new_array(context._jvm.double, rounds)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    short = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    out = GBTClassificationModel(short)
    return out.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


class _SearchTable:
    """Scores of finished fits below a folder, one small file each, so that a search that was
    stopped goes on where it was. Without a folder nothing is kept."""

    FIELDS = "fit int, fold int, setting int, score double, seconds double"

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.known = {}
        if folder and exists(spark, folder):
            for row in spark.read.schema(self.FIELDS).json(f"{folder}/*").collect():  # one for each setting and fold
                self.known.setdefault((row["fit"], row["fold"]), []).append((row["setting"], row["score"], row["seconds"]))

    def add(self, unit, rows):
        if self.folder:
            table = self.spark.createDataFrame([(*unit, *r) for r in rows], self.FIELDS)
            table.coalesce(1).write.mode("overwrite").json(f"{self.folder}/fit-{unit[0]}-fold-{unit[1]}")


def grid_search(train, name, grid, key, folds=5, score="f1", label=S.LABEL, seed=42, parallelism=None, store=None):
    """(best pipeline, results): exhaustive search over stratified folds.

    The training rows with their folds are written once and every fit reads that copy. Fits
    run side by side, each with its own clock; one of trees over rows that a task holds is one
    task (see ensembles). Settings of boosting that differ in the number
    of rounds only share one fit of the most rounds (see shortened), whose time they all
    report. store names a folder that keeps the scores of finished fits; a search that is
    started again with it, over the same rows and grid, does not repeat them.
    """
    spark, names = train.sparkSession, features_in(train)
    checkpoint_folder(spark)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    keys = [key] if isinstance(key, str) else list(key)
    rows = assign_folds(train.select(*dict.fromkeys([*keys, label, *names])), keys, folds, label)
    rows = materialize(assembler.transform(rows).select("features", F.col(label).cast("double").alias(label), "fold"))
    estimator, table = ESTIMATORS[name](seed).setLabelCol(label), E.Rows(rows, label, len(names))
    n, whole = table.n, all(table.fit_here(_with(estimator, s)) for s in settings_of(grid, max(table.n, 1)))
    tasks = 1 if whole else max(1, n // ROWS_OF_A_TASK)
    rows = rows.coalesce(tasks)
    others = [rows.filter(F.col("fold") != k) for k in range(folds)]
    if whole:
        cuts = [table.borders(seed, o, o.count()) for o in others]
    elif tasks == 1:  # a small table's thousands of short jobs each carry the plan that reads it
        others = [checkpointed(o) for o in others]
    # jobs of few tasks wait for the driver more than they compute, so many fits go side by side; whole fits compute more
    parallelism = parallelism or min(64, max(4, (2 if whole else 6) * spark.sparkContext.defaultParallelism // tasks))
    settings, judge = settings_of(grid, n), evaluator(score, label)
    fits = {}  # settings that share a fit, by what they have in common
    for i, setting in enumerate(settings):
        common = tuple((p, v) for p, v in setting.items() if p != "maxIter")
        fits.setdefault(common, []).append(i)
    fits, kept = list(fits.values()), _SearchTable(spark, store)

    def run(unit):
        if unit in kept.known:
            return unit, kept.known[unit]
        members, fold = fits[unit[0]], unit[1]
        if whole:
            votes = E.scored_fold(estimator, settings, members, table, cuts[fold], fold)
            seconds = votes.agg(F.max("seconds")).first()[0] or 0.0
            found = [(i, float(judge.evaluate(E.judged(votes, i, label))), seconds) for i in members]
            kept.add(unit, found)
            return unit, found
        longest = max(members, key=lambda i: settings[i].get("maxIter", 0))
        start = time.time()
        model = _with(estimator, settings[longest]).fit(others[fold])
        seconds, held, found = time.time() - start, rows.filter(F.col("fold") == fold), []
        for i in members:
            scored = model if i == longest else shortened(model, settings[i]["maxIter"])
            found.append((i, float(judge.evaluate(scored.transform(held))), seconds))
        kept.add(unit, found)
        return unit, found

    # the slowest fits first, so that none is left alone at the end
    units = sorted(((f, k) for f in range(len(fits)) for k in range(folds)), key=lambda u: -settings[fits[u[0]][0]].get("maxDepth", 0))
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(spark)(run), units, chunksize=1)
    scores, seconds = [[0.0] * folds for _ in settings], [0.0] * len(settings)
    for (_, fold), rows_found in found:
        for i, value, took in rows_found:
            scores[i][fold] = value
            seconds[i] += took
    means = [sum(s) / folds for s in scores]
    best = max(range(len(settings)), key=lambda i: means[i])
    # one row per parameter setting
    results = spark.createDataFrame(
        [
            (name, {p: str(v) for p, v in t.items()}, m, (sum((x - m) ** 2 for x in s) / folds) ** 0.5, s, took)
            for t, m, s, took in zip(settings, means, scores, seconds)
        ],
        "model string, params map<string,string>, mean_score double, std_score double, fold_scores array<double>, training_time double",
    )
    return PipelineModel([assembler, E.fitted(_with(estimator, settings[best]), table)]), results


def predictions(model, df, label=S.LABEL):
    """Rows with an int prediction and the probability of the positive class."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    drop = [c for c in ("features", "rawPrediction", "probability") if c in out.columns]
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop(*drop)


def train_and_select(train, validation, key, grids, folds=5, seed=42, store=None):
    """(best model, its name, its metrics row, all results): the winner by weighted f1 on validation.

    store: see grid_search; each family has a folder of its own below it.
    """
    spark, candidates, tables, scores = train.sparkSession, {}, None, []
    for name, grid in grids.items():
        model, results = grid_search(train, name, grid, key, folds, seed=seed, store=store and f"{store}/{name}")
        found = M.weighted_metrics(predictions(model, validation), S.LABEL, "prediction").first()
        candidates[name] = (model, found)
        scores.append((name, found["f1_score"]))
        tables = results if tables is None else tables.unionByName(results)
    scored = spark.createDataFrame(scores, "model string, f1_score double")
    best = M.best_candidate(scored, "model", "f1_score").first()["model"]
    model, found = candidates[best]
    return model, best, found, tables


def feature_importance(spark, model, names):
    """Features of a tree model by importance, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def coefficients(model, names):
    """{feature: coefficient} of a linear model, for operators.metrics.linear_contributions."""
    return dict(zip(names, (float(v) for v in model.stages[-1].coefficients.toArray())))
