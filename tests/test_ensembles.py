"""Trees that are grown inside tasks: those of Spark, without its jobs for each level; forests that stay in a table."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.plans import ensembles as E
from wardflow.plans import training
from wardflow.plans import trees as T

NAMES = ["HR", "WBC", "M"]


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with a feature of many values, one of many zeros and one of two values."""
    n = F.col("id") * 7919 % 3001
    hr, wbc = (n * 37 % 1013).cast("double"), F.greatest(n * 53 % 97 - 40, F.lit(0)) / 10
    label = ((n * 11 % 7 < 2) | ((hr > 700) & (wbc > 1))).cast("bigint")
    return spark.range(0, 900, numPartitions=3).select("id", hr.alias("HR"), wbc.alias("WBC"), (n % 2).cast("double").alias("M"), label.alias(S.LABEL)).localCheckpoint()


def assembled(rows):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)


def table(rows):
    return E.Rows(assembled(rows), S.LABEL, len(NAMES))


def probabilities(model, rows):
    return {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability").alias("p")).collect()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def here(rows, params):
    """A forest as training.fit makes it of larger tables: small enough for a model of Spark's."""
    one = RandomForestClassifier(labelCol=S.LABEL, seed=42, **params)
    return PipelineModel([VectorAssembler(inputCols=NAMES, outputCol="features"), E.fitted(one, table(rows))])


def level_stages(spark, group, run):
    """Result of run and how many of its stages are levels of Spark's trees."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages
    return out, sum(1 for s in stages if s and ("RandomForest.scala" in s.name or "Tree" in s.name))


def test_boosting_in_a_task_is_sparks(spark, rows):
    one = GBTClassifier(labelCol=S.LABEL, seed=42, maxIter=6, maxDepth=5, stepSize=0.2)
    wanted, found = one.fit(assembled(rows.coalesce(1))), E.fitted(one, table(rows))
    assert [t.numNodes for t in found.trees] == [t.numNodes for t in wanted.trees] and found.treeWeights == wanted.treeWeights
    assert same(probabilities(found, assembled(rows)), probabilities(wanted, assembled(rows)))
    assert np.allclose(found.featureImportances.toArray(), wanted.featureImportances.toArray())


def test_single_trees_are_sparks(rows):
    data = [(r["HR"], r["WBC"], r["M"], r[S.LABEL]) for r in rows.collect()]
    values, labels = np.array([d[:3] for d in data]), np.array([d[3] for d in data], float)
    cuts = [T.borders(values[:, f], len(data)) for f in range(3)]
    bins, sums = T.binned(values, cuts), [(labels == c).astype(float) for c in (0, 1)]
    for depth, least in ((30, 2), (4, 20)):
        wanted = DecisionTreeClassifier(labelCol=S.LABEL, maxDepth=depth, minInstancesPerNode=least).fit(assembled(rows))
        whole, leaf = T.grow(bins, [len(c) for c in cuts], sums, np.arange(len(data)), depth, least, T.gini)
        tree, into = whole.pruned(T.gini)
        assert len(tree.feature) == wanted.numNodes and (into[leaf] == tree.leaves(bins)).all()
        assert np.allclose(tree.importances(3, T.gini), wanted.featureImportances.toArray())
        found = wanted.transform(assembled(rows)).select(vector_to_array("probability").alias("p")).collect()
        assert np.allclose(T.shares(tree)[tree.leaves(bins)], [r["p"] for r in found])


SEARCHES = {
    "Gradient_Boosted_Trees": {"maxIter": [2, 5], "maxDepth": [3, 4], "stepSize": [0.1]},
    "Decision_Tree": {"maxDepth": [30, 4], "minInstancesPerNode": [2, 10]},
}


@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_starts_no_job_for_a_level_and_has_sparks_scores(spark, rows, monkeypatch, name):
    def search():
        return [r.asDict() for r in training.grid_search(rows, name, SEARCHES[name], "id", folds=2)[1].collect()]

    found, levels = level_stages(spark, f"{name} in tasks", search)
    monkeypatch.setattr(E, "TASK_CELLS", 0)  # Spark's own learners
    assert levels <= (0 if name == "Gradient_Boosted_Trees" else 2 * 31 + 10)  # the best single tree is fitted again by Spark
    wanted = search()
    assert [f["params"] for f in found] == [w["params"] for w in wanted]
    for f, w in zip(found, wanted):
        assert np.allclose(f["fold_scores"], w["fold_scores"]) and f["training_time"] > 0


def test_a_search_of_forests_starts_no_job_for_a_level(spark, rows):
    grid = {"numTrees": [5, 20], "maxDepth": [3, 8], "minInstancesPerNode": [1, 5]}
    (model, results), levels = level_stages(spark, "forests in tasks", lambda: training.grid_search(rows, "Random_Forest_Classifier", grid, "id", folds=3))
    assert levels == 0
    results = results.collect()
    assert len({str(r["params"]) for r in results}) == len(results) == 8 and all(len(r["fold_scores"]) == 3 for r in results)
    assert all(0 < s <= 1 for r in results if r["params"]["maxDepth"] == "8" for s in r["fold_scores"])
    best = max(results, key=lambda r: r["mean_score"])["params"]
    forest = model.stages[-1]
    assert {p: str(getattr(forest, f"get{p[0].upper()}{p[1:]}")()) if p != "numTrees" else str(len(forest.trees)) for p in best} == best


def test_the_score_of_a_fold_is_that_of_its_forest(spark, rows):
    """Votes of a search are those of the model fitted to the other folds."""
    folded = assembled(rows).withColumn("fold", (F.col("id") % 2).cast("int"))
    one, whole = RandomForestClassifier(labelCol=S.LABEL, seed=42, numTrees=7, maxDepth=6), E.Rows(folded, S.LABEL, 3)
    train, held = folded.filter("fold = 1"), folded.filter("fold = 0")
    cuts = whole.borders(42, train, train.count())
    votes = E.scored_fold(one, [{}], [0], whole, cuts, 0)
    model = E.fitted(one, E.Rows(train, S.LABEL, 3))
    for score in ("f1", "weighted_recall", "roc_auc"):
        judge = training.evaluator(score)
        assert judge.evaluate(E.judged(votes, 0, S.LABEL)) == pytest.approx(judge.evaluate(model.transform(held)))


def test_forests_have_the_asked_trees_and_do_not_depend_on_the_layout(rows):
    one = RandomForestClassifier(labelCol=S.LABEL, seed=42, numTrees=30, maxDepth=9, minInstancesPerNode=4)
    found, other = E.fitted(one, table(rows)), E.fitted(one, table(rows.repartition(5, "WBC")))
    assert same(probabilities(found, assembled(rows)), probabilities(other, assembled(rows)))
    assert len(found.trees) == 30 and max(t.depth for t in found.trees) <= 9 and len({t.toDebugString.split("\n", 1)[1] for t in found.trees}) > 20
    spark_forest = one.fit(assembled(rows))
    right = [
        np.mean([p.index(max(p)) == labels[i] for i, p in probabilities(m, assembled(rows)).items()])
        for labels in [{r["id"]: r[S.LABEL] for r in rows.collect()}] for m in (found, spark_forest)
    ]
    assert abs(right[0] - right[1]) < 0.03
    assert np.abs(found.featureImportances.toArray() - spark_forest.featureImportances.toArray()).max() < 0.1
    assert not same(probabilities(found, assembled(rows)), probabilities(E.fitted(one.copy({one.seed: 43}), table(rows)), assembled(rows)))


def test_a_forest_of_many_nodes_stays_a_table(rows, monkeypatch, tmp_path):
    params = {"numTrees": 9, "maxDepth": 8, "minInstancesPerNode": 2}
    small = here(rows, params)
    monkeypatch.setattr(E, "DRIVER_NODES", 0)
    monkeypatch.setattr(E, "PART_ROWS", 200)
    large = training.fit(rows, "Random_Forest_Classifier", params)
    assert isinstance(large.stages[-1], E.ForestModel) and not isinstance(small.stages[-1], E.ForestModel)
    assert same(probabilities(large, rows), probabilities(small, rows))
    assert np.allclose(large.stages[-1].featureImportances.toArray(), small.stages[-1].featureImportances.toArray())
    wanted = training.predictions(small, rows).select("id", "prediction").collect()
    assert sorted(training.predictions(large, rows).select("id", "prediction").collect()) == sorted(wanted)
    large.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert isinstance(again.stages[-1], E.ForestModel) and same(probabilities(again, rows), probabilities(small, rows))


def test_other_settings_and_odd_labels_are_sparks_business(rows):
    assert not table(rows).fit_here(RandomForestClassifier(labelCol=S.LABEL, maxBins=16))
    assert not table(rows.limit(0)).fit_here(GBTClassifier(labelCol=S.LABEL))
    assert not table(rows.withColumn(S.LABEL, F.lit(0.5))).fit_here(RandomForestClassifier(labelCol=S.LABEL))
    three = table(rows.withColumn(S.LABEL, F.col("id") % 3))
    assert not three.fit_here(GBTClassifier(labelCol=S.LABEL))
    model = E.fitted(RandomForestClassifier(labelCol=S.LABEL, numTrees=3, seed=1), three)
    assert model.numClasses == 3 and all(sum(p) == pytest.approx(1) for p in probabilities(model, assembled(rows)).values())


def test_importances_of_a_forest_in_a_table(spark, rows, monkeypatch):
    params = {"numTrees": 6, "maxDepth": 5}
    small = here(rows, params)
    monkeypatch.setattr(E, "DRIVER_NODES", 0)
    large = training.fit(rows, "Random_Forest_Classifier", params)
    found, wanted = ([tuple(r) for r in training.feature_importance(spark, m, NAMES).collect()] for m in (large, small))
    assert [f for f, _ in found] == [f for f, _ in wanted] and np.allclose([v for _, v in found], [v for _, v in wanted])
    assert sum(v for _, v in found) == pytest.approx(1) and isinstance(large.stages[-1], E.ForestModel)


def test_selection_starts_jobs_for_the_levels_of_one_tree_only(spark, rows, monkeypatch, tmp_path):
    grids = {
        "Random_Forest_Classifier": {"numTrees": [3], "maxDepth": [6], "minInstancesPerNode": [5]},
        "Gradient_Boosted_Trees": {"maxIter": [2], "maxDepth": [3], "stepSize": [0.1]},
        "Logistic_Regression": {"C": [1.0]},
        "Decision_Tree": {"maxDepth": [30], "minInstancesPerNode": [10]},
    }
    train, held = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    _, one = level_stages(spark, "one tree", lambda: training.fit(train, "Decision_Tree", {"maxDepth": 30, "minInstancesPerNode": 10}))
    (_, best, found, results), levels = level_stages(spark, "selection", lambda: training.train_and_select(train, held, "id", grids, folds=2))
    assert best in grids and found["f1_score"] > 0.5 and {r["model"] for r in results.collect()} == set(grids)
    assert 0 < one and levels <= one + 2  # the best single tree is fitted again by Spark
    monkeypatch.setattr(E, "DRIVER_NODES", 0)  # a winning forest that stays a table can be saved
    forest = {"Random_Forest_Classifier": grids["Random_Forest_Classifier"]}
    model, _, found, _ = training.train_and_select(train, held, "id", forest, folds=2)
    model.write().overwrite().save(f"{tmp_path}/model")
    scored = training.predictions(PipelineModel.load(f"{tmp_path}/model"), held)
    assert scored.filter(F.col("prediction") == F.col(S.LABEL)).count() / held.count() == pytest.approx(found["accuracy"])


def test_a_forest_that_is_surely_small_is_sparks(rows, monkeypatch):
    params = {"numTrees": 5, "maxDepth": 4}
    one = RandomForestClassifier(labelCol=S.LABEL, seed=42, cacheNodeIds=True, **params)
    assert same(probabilities(training.fit(rows, "Random_Forest_Classifier", params), rows), probabilities(one.fit(assembled(rows)), assembled(rows)))
    deep = RandomForestClassifier(numTrees=100, maxDepth=20, minInstancesPerNode=5)
    assert E.surely_small(deep, 12_500) and not E.surely_small(deep, 12_600)
