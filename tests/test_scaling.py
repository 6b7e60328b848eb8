"""Work is dealt out by its size: deep trees, listings of many folders, long lines of one file."""

import glob

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.plans import training
from wardflow.sources import readers
from wardflow.streaming import streams


def test_deep_trees_keep_the_node_of_each_row(spark):
    rows = spark.range(600).select(
        "id", (F.col("id") * 37 % 101).cast("double").alias("HR"), (F.col("id") * 53 % 97).cast("double").alias("WBC"),
        ((F.col("id") * 11 % 7) < 3).cast("bigint").alias(S.LABEL),
    )
    for name in ("Random_Forest_Classifier", "Decision_Tree"):
        assert training.ESTIMATORS[name](42).getCacheNodeIds()
        kept, walked = (training.fit(rows, name, {"maxDepth": 12, "cacheNodeIds": keep}).stages[-1] for keep in (True, False))
        assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_boosting_takes_few_tasks_and_short_lineage(spark):
    rows = spark.range(0, 600, numPartitions=6).select(
        "id", (F.col("id") * 37 % 101).cast("double").alias("HR"), (F.col("id") * 53 % 97).cast("double").alias("WBC"),
        ((F.col("id") * 11 % 7) < 3).cast("bigint").alias(S.LABEL),
    )
    assert training.ESTIMATORS["Gradient_Boosted_Trees"](42).getCheckpointInterval() <= 3
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        model = training.fit(rows, "Gradient_Boosted_Trees", {"maxIter": 4, "maxDepth": 4}).stages[-1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("boosting") for s in tracker.getJobInfo(j).stageIds]
    levels = [s.numTasks for s in stages if s and "RandomForest.scala" in s.name]
    assert levels and max(levels) == 1
    assembled = VectorAssembler(inputCols=["HR", "WBC"], outputCol="features").transform(rows)
    plain = GBTClassifier(labelCol=S.LABEL, seed=42, maxIter=4, maxDepth=4).fit(assembled)
    found, wanted = ({r["id"]: r["probability"][1] for r in m.transform(assembled).collect()} for m in (model, plain))
    assert len(found) == 600 and all(abs(found[i] - wanted[i]) < 1e-9 for i in found)


def test_the_lines_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    body = F.to_json(F.struct(F.array(F.array(*[F.lit("1")] * len(S.REQUEST_COLUMNS))).alias("data"), F.array(*map(F.lit, S.REQUEST_COLUMNS)).alias("columns")))
    lines = spark.range(200, numPartitions=1).select(F.lit("same").alias("request"), F.concat(body, F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("value"), F.current_timestamp().alias("arrived"))
    lines.write.parquet(f"{tmp_path}/lines")
    stream = streams.file_stream(spark, f"{tmp_path}/lines", lines.schema, "parquet")
    none = F.lit(None).cast("int").alias("prediction")
    streams.score_stream(stream, lambda rows: rows.select("request", "row", "arrived", none), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out/parsed").count() == 200
    assert len(glob.glob(f"{tmp_path}/out/parsed/run=0/part-*.parquet")) > 1


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"p{i:06d}").mkdir()
        (tmp_path / f"p{i:06d}" / f"p{i:06d}.psv").write_text("|".join(S.RAW_FILE.names) + "\n" + "|".join(["1"] * len(S.RAW_FILE.names)) + "\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows, rejects = readers.ingest_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert rows.select(S.KEY).distinct().count() == rows.count() == 300 and rejects.count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
