"""Forests and boosting whose trees are grown whole inside tasks (plans/trees.py).

A task takes the rows of a table, cut into bins, and grows trees of a forest, or all rounds of boosting: no
job for each level, nothing of a tree on the driver. A small model is handed over as Spark's own; a forest of
many nodes stays a table and scores by a shuffle (ForestModel).
"""

import json
import time
from functools import partial, reduce

import numpy as np
import pyspark
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from wardflow.plans import trees as T
from wardflow.session import materialize, new_folder

#: Rows times features that a task holds, a byte each; larger tables are fitted by Spark's own learners.
TASK_CELLS = 64_000_000
#: Nodes of a model that is loaded as Spark's, some hundred bytes each on the driver and in tasks.
DRIVER_NODES = 500_000
#: Rows of a part that is scored by a table of trees.
PART_ROWS = 250_000
#: Settings the learners here know; with any other, Spark's learners fit.
KNOWN = {
    "seed", "labelCol", "featuresCol", "predictionCol", "rawPredictionCol", "probabilityCol", "maxDepth", "minInstancesPerNode", "cacheNodeIds",
    "checkpointInterval", "maxMemoryInMB", "numTrees", "maxIter", "stepSize",
}


class Rows:
    """Rows (features, label) with what a learner has to know about them."""

    def __init__(self, rows, label, features):
        self.rows, self.label, self.features = rows, label, features
        y = F.col(label)
        odd = F.count_if(y.isNull() | (y != F.floor(y)) | (y < 0))
        self.n, top, odd = rows.agg(F.count(F.lit(1)), F.max(y), odd).first()
        self.classes = int(top) + 1 if self.n and not odd else 0

    def fit_here(self, estimator):
        """Whether trees of the estimator's kind are grown in tasks; else, and to refuse odd labels, Spark's learner is asked."""
        if not isinstance(estimator, (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)):
            return False
        if not {p.name for p in estimator._paramMap} <= KNOWN or not 0 < self.n * self.features <= TASK_CELLS:
            return False
        return self.classes == 2 or self.classes > 2 and not isinstance(estimator, GBTClassifier)

    def cells(self, *more):
        """Feature values and labels, read by one task."""
        rows = self.rows.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), *more)
        return rows.coalesce(1)

    def borders(self, seed, rows=None, n=None):
        """Borders of each feature, from all rows or a sample, as Spark's learners take them."""
        rows, n = (self.rows, self.n) if rows is None else (rows, n)
        share = min(1.0, T.SAMPLE / max(n, 1))
        some = rows if share == 1.0 else rows.sample(False, share, seed)
        values = some.select(vector_to_array("features").alias("x")).toArrow()["x"].combine_chunks()
        values = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.features)
        return [T.borders(values[:, f], n, share) for f in range(self.features)]


def _options(estimator, features):
    shared = {"depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode()}
    if isinstance(estimator, GBTClassifier):
        return shared | {"rate": estimator.getStepSize()}
    if isinstance(estimator, DecisionTreeClassifier):
        return shared
    subset = features if estimator.getNumTrees() == 1 else int(np.ceil(np.sqrt(features)))
    return shared | {"seed": estimator.getSeed(), "subset": subset}


def surely_small(estimator, n):
    """Whether a forest over n rows has at most DRIVER_NODES nodes, however its trees come out."""
    each = min(2 ** (estimator.getMaxDepth() + 1), max(1, 2 * n // estimator.getMinInstancesPerNode()))
    return estimator.getNumTrees() * each <= DRIVER_NODES


def fitted(estimator, table):
    """The model of the estimator over the Rows of table."""
    if isinstance(estimator, DecisionTreeClassifier) or not table.fit_here(estimator):
        return estimator.fit(table.rows)
    spark, cuts, options = table.rows.sparkSession, table.borders(estimator.getSeed()), _options(estimator, table.features)
    if isinstance(estimator, GBTClassifier):
        grown = table.cells().mapInArrow(partial(T.boosted_rows, cuts=cuts, rounds=estimator.getMaxIter(), **options), T.TREES)
        return as_spark(estimator, materialize(grown), cuts, table.classes)
    n_trees = estimator.getNumTrees()
    tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
    options = options | {"cuts": cuts, "classes": table.classes}
    dealt = [partial(T.forest_rows, numbers=range(i, n_trees, tasks), **options) for i in range(tasks)]
    grown = materialize(reduce(lambda a, b: a.unionAll(b), [table.cells().mapInArrow(grow, T.TREES) for grow in dealt]))
    if grown.agg(F.sum("nodes")).first()[0] <= DRIVER_NODES:
        return as_spark(estimator, grown, cuts, table.classes)
    model = ForestModel(grown, cuts, table.classes)
    columns = {p: estimator.getOrDefault(p) for p in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")}
    return model._set(**columns)


def as_spark(estimator, grown, cuts, classes):
    """A table of trees as Spark's model of the estimator: written as Spark saves one, and loaded."""
    spark, folder, boosting = grown.sparkSession, new_folder(grown.sparkSession, "model"), isinstance(estimator, GBTClassifier)
    kind, model = (T.variance, GBTClassificationModel) if boosting else (T.gini, RandomForestClassificationModel)
    package = "org.apache.spark.ml"
    tree_class = f"{package}.regression.DecisionTreeRegressionModel" if boosting else f"{package}.classification.DecisionTreeClassificationModel"
    stamp = {"timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__}
    params = [{p.name: v for p, v in found.items()} for found in (estimator._paramMap, estimator._defaultParamMap)]
    weights = [(r["tree"], r["weight"]) for r in grown.select("tree", "weight").collect()]
    head = {"class": f"{package}.classification.{model.__name__}", **stamp, "uid": estimator.uid, "paramMap": params[0], "defaultParamMap": params[1]}
    head |= {"numFeatures": len(cuts), "numTrees": len(weights)} | ({} if boosting else {"numClasses": classes})
    extra = {"numFeatures": len(cuts)} | ({} if boosting else {"numClasses": classes})
    each = [
        (i, json.dumps({"class": tree_class, **stamp, "uid": f"{estimator.uid}_tree_{i}", "paramMap": {}, "defaultParamMap": {}, **extra}), w) for i, w in weights
    ]
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    grown.mapInArrow(partial(T.spark_nodes, cuts=cuts, kind=kind), T.NODES).write.parquet(f"{folder}/data")
    return model.load(folder)


def scored_fold(estimator, settings, members, table, cuts, fold):
    """Votes (setting, label, raw, seconds) on the rows of a fold by the settings that share a fit of the other rows.

    The table has a column fold; settings of a shared fit differ in the number of rounds only.
    """
    one = estimator.copy({estimator.getParam(p): v for p, v in settings[members[0]].items()})
    options = _options(one, table.features) | {"cuts": cuts, "fold": fold}
    if isinstance(estimator, GBTClassifier):
        run = partial(T.boosted_votes, marks=[(i, settings[i].get("maxIter", estimator.getMaxIter())) for i in members], **options)
    elif isinstance(estimator, DecisionTreeClassifier):
        run = partial(T.tree_votes, setting=members[0], classes=table.classes, **options)
    else:
        run = partial(T.forest_votes, setting=members[0], n_trees=one.getNumTrees(), classes=table.classes, **options)
    return materialize(table.cells("fold").mapInArrow(run, T.VOTES))


def _voted(rows, raw, names):
    """rows with raw votes, probabilities and the class with most votes, under the given names."""
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    first = (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
    values = (array_to_vector(raw), array_to_vector(F.transform(raw, lambda x: x / total)), first)
    return rows.withColumns(dict(zip(names, values)))


def judged(votes, setting, label):
    """Votes of one setting as an evaluator takes them."""
    rows = votes.filter(F.col("setting") == setting).select(F.col("label").alias(label), "raw")
    first = (F.array_position("raw", F.array_max("raw")) - 1).cast("double")
    return rows.select(label, array_to_vector("raw").alias("rawPrediction"), first.alias("prediction"))


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        model = self.model
        head = {"cuts": [c.tolist() for c in model.cuts], "classes": model.classes}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, head)
        model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path):
        head = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        grown = self.sparkSession.read.schema(DataType.fromDDL(T.TREES)).parquet(f"{path}/trees")
        model = ForestModel(grown, [np.array(c) for c in head["cuts"]], head["classes"])
        model._resetUid(head["uid"])
        DefaultParamsReader.getAndSetParams(model, head)
        return model


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """A forest whose trees stay in a table; neither the driver nor a task holds all of them."""

    def __init__(self, grown, cuts, classes):
        super().__init__()
        self.trees, self.cuts, self.classes = grown, cuts, classes

    @property
    def featureImportances(self):
        """As of Spark's forests: shares of each tree, added up, as shares."""
        total = np.zeros(len(self.cuts))
        for row in self.trees.select("tree", "importances").orderBy("tree").toLocalIterator():
            total += row["importances"]
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, df):
        """df, written once, with the votes of all trees.

        Parts of the rows meet some of the trees each; the votes of a part are added in the order of the trees.
        """
        spark, number = df.sparkSession, "_forest_row"
        kept = materialize(df.withColumn(number, F.monotonically_increasing_id()))
        n, n_trees = kept.count(), self.trees.count()
        parts, some = max(1, -(-n // PART_ROWS)), min(n_trees, 4 * spark.sparkContext.defaultParallelism)
        cells = kept.select(F.col(number).alias("id"), vector_to_array(self.getFeaturesCol()).alias("x"))
        pack = partial(T.packed_rows, cuts=self.cuts, parts=parts)
        blocks = cells.mapInArrow(pack, "part int, ids binary, bins binary")
        left = blocks.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit(some - 1))))
        right = self.trees.drop("importances").withColumns({"some": F.col("tree") % some, "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        features, classes = len(self.cuts), self.classes

        def vote(key, rows, grown):
            return T.part_votes(key, rows, grown, features, classes)

        def add(table):
            return T.all_votes(table, classes, number)

        votes = left.groupBy("part", "some").cogroup(right.groupBy("part", "some")).applyInArrow(vote, T.PART)
        votes = materialize(votes.groupBy("part").applyInArrow(add, f"{number} bigint, votes array<double>"))
        names = [self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()]
        return _voted(kept.join(votes, number), F.col("votes"), names).drop(number, "votes")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

