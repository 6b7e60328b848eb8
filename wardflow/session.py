"""Session helpers: work folder, materialisation and settings used by the jobs."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores=8, **conf):
    """A session for tests and the benchmark; cluster jobs bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wardflow")
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """Folder every executor can reach: spark.checkpoint.dir, or a new one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = "file:" + tempfile.mkdtemp(prefix="wardflow-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark, values):
    """Session settings that hold inside a with block; what they were before comes back after it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Options of a write into the shared folder. They bear on local disks only: there Hadoop, without its native library,
#: starts a process for the permissions of each file, one for those of its checksum file and one for those of its folder, and
#: until it begins such a process counts as a second copy of its JVM. Without checksum files there are two in place of
#: three; parquet pages have checksums of their own.
WRITES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Write df once as a table in the shared folder and go on from there.

    Used where one input feeds several actions (fits, folds, small border tables). A
    lost executor costs a re-read, never a recompute, and the planner sees the real
    size. The folders belong to the run; whoever owns the shared folder clears it.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.options(**WRITES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark):
    """Sees to it that checkpoints of iterative fits have the shared folder to go to."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df):
    """df without the plan it came from: a checkpoint in the shared folder.

    For small tables that thousands of short jobs read; larger ones are materialized.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
