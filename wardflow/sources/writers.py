"""Sinks: tables, JSON artifacts, append-only logs, and versioned tables with a pointer."""

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.functions.scalars import model_version


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_table(df, path, by=()):
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_csv(df, path, sep=",", by=()):
    """CSV with a header; `by` makes one folder per value, as for cohorts."""
    df.write.mode("overwrite").partitionBy(*by).option("header", True).option("sep", sep).csv(path)


def save_json(df, path):
    df.write.mode("overwrite").json(path)


def append_scored(df, path):
    """Append scored rows with the time of writing; earlier rows are never read back."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_log(df, path):
    """Append to the scoring log; the first write creates it."""
    names = [f.name for f in S.SCORING_LOG]
    df.select(*[F.col(f.name).cast(f.dataType) for f in S.SCORING_LOG], *[c for c in df.columns if c not in names]).write.mode(
        "append"
    ).parquet(path)


def read_log(spark, path):
    """The scoring log; an empty table where nothing was logged yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], S.SCORING_LOG)
    return spark.read.parquet(path)


POINTER = "version bigint, path string, parent bigint"


class Versioned:
    """A table of which every write is a new folder, and a pointer row that names the current one.

    A failed or cancelled write leaves the pointer, so going back costs nothing.
    """

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self):
        path = f"{self.folder}/pointers"
        if not exists(self.spark, path):
            return None
        return self.spark.read.schema(POINTER).json(path)

    def _current(self):
        """Pointer of the current version; version 0 without a path before the first."""
        pointers = self._pointers()
        row = pointers.orderBy(F.desc("version")).first() if pointers else None
        return (row["version"], row["path"], row["parent"]) if row else (0, None, None)

    def read(self):
        path = self._current()[1]
        return None if path is None else self.spark.read.parquet(path)

    def stage(self, df):
        """Write df as a version that is not current yet; returns its path."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _point(self, path, parent, version):
        """Publish the next version, if nobody else has meanwhile: its file is created or exists."""
        pointer = json.dumps({"version": version, "path": path, "parent": parent})
        if not create_file(self.spark, f"{self.folder}/pointers/{version:012d}.json", pointer):
            raise Conflict(f"version {version} was published by another writer")

    def switch(self, path):
        """Make a staged version the current one; the version before it becomes its parent.

        Of two writers that switch at the same time both get a version of their own, one
        after the other.
        """
        while True:
            current = self._current()[0]
            try:
                return self._point(path, current or None, current + 1)
            except Conflict:
                continue

    def revert(self):
        """Go back to the parent of the current version; repeated, to its parent, and so on.
        Raises Conflict when another writer published a version meanwhile."""
        version, _, parent = self._current()
        row = self._pointers().filter(F.col("version") == parent).first() if parent else None
        if row is None:
            raise ValueError("there is no earlier version")
        self._point(row["path"], row["parent"], version + 1)


class BatchLog:
    """An append-only table of numbered batches, each in it once or not at all.

    A batch is written to a folder of its own and then entered in the ledger, by a file that
    can be created once only. Readers take the folders in the ledger, so what a failed or
    repeated attempt left behind does not count.
    """

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, df, batch):
        """Add df as this batch, unless the ledger has it; returns the rows of the batch."""
        entry = f"{self.folder}/ledger/{batch}.json"
        if not exists(self.spark, entry):
            attempt = f"a-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/rows/batch={batch}/attempt={attempt}")
            create_file(self.spark, entry, json.dumps({"batch": batch, "attempt": attempt}))
        return self.read().filter(F.col("batch") == batch).drop("batch")

    def read(self):
        """All rows of the batches in the ledger, with the number of their batch."""
        ledger = self.spark.read.schema("batch bigint, attempt string").json(f"{self.folder}/ledger")
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        rows = rows.withColumn("batch", F.col("batch").cast("bigint"))
        return rows.join(ledger, ["batch", "attempt"], "left_semi").drop("attempt")


class Conflict(Exception):
    """Another writer was faster."""


def create_file(spark, path, text):
    """Create a file with this text; False if there is one already, which stays as it is.

    The text is written beside it and moved to the name in one step that fails if the name is
    taken: a link on a local disk, a rename without overwriting elsewhere.
    """
    java, name = spark._jvm.org.apache.hadoop.fs, path.rsplit("/", 1)
    target, draft = java.Path(path), java.Path(f"{name[0]}/.{name[1]}-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    out = system.create(draft, False)
    out.write(bytearray(f"{text}\n".encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            context = java.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
            no_options = spark.sparkContext._gateway.new_array(java.Options.Rename, 0)
            context.rename(system.makeQualified(draft), system.makeQualified(target), no_options)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if system.exists(target):
            return False
        raise error
    finally:
        system.delete(draft, False)
    return True


def publish(spark, staged, path):
    """Rename a finished folder to its final name, in one step of the file system."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"cannot rename {staged} to {path}")


def next_model_path(spark, folder, prefix, stamp):
    """folder/prefix_<stamp>_v<N>.model, N one above the highest version of the prefix."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    # folder names only: one per saved model
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    versions = spark.createDataFrame([(n,) for n in names], "name string").filter(F.col("name").startswith(prefix))
    top = versions.agg(F.coalesce(F.max(model_version("name")), F.lit(0))).first()[0]
    return f"{folder}/{prefix}_{stamp}_v{top + 1}.model"
