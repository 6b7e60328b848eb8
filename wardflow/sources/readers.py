"""Readers: one scan over many files, always with a declared schema."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow import schema as S
from wardflow.functions import scalars as X
from wardflow.session import materialize, settings

CSV = {"sep": "|", "header": "true", "nullValue": "NaN", "enforceSchema": "true"}


def many_small_files(spark):
    """Settings for a scan of very many small files: a few listing tasks for each core, not one for
    every few folders, and some hundred files in a task, so that what it writes is not as many files again."""
    return {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism,
        "spark.sql.files.openCostInBytes": 512 * 1024,
    }


class NoFiles(Exception):
    """No file of the wanted kind is in the folder."""


def patient_files(spark, paths, id_rule="file_name", name_glob="*.psv"):
    """All patient files of the folders as one table, the patient id taken from the file name.

    One scan, whatever the number of files. Small files are packed into tasks by
    spark.sql.files.maxPartitionBytes and openCostInBytes. For repeated use write the
    result once with sources.writers.save_table.
    """
    reader = spark.read.schema(S.RAW_FILE).options(**CSV).option("pathGlobFilter", name_glob)
    rows = reader.csv(paths)
    if rows.isEmpty():
        raise NoFiles(f"no rows in {name_glob} files of {paths}")
    return rows.withColumn(S.KEY, X.id_from_path(F.col("_metadata.file_path"), id_rule))


def ingest_files(spark, paths, columns=None, id_rule="file_name", name_glob="*.psv"):
    """(rows, rejects): the records of all delimited files below the folders, each parsed once.

    columns names those that the files hold, in their order; others of the schema are null in
    rows. A record with another number of fields, or with text where a number belongs, is
    refused as a whole: rejects has its text, file and patient id. Parsed records are written
    to the shared folder, and both results read that table.
    """
    names = columns or S.RAW_FILE.names
    schema = T.StructType([S.RAW_FILE[c] for c in names] + [T.StructField("_record", T.StringType())])
    reader = spark.read.schema(schema).options(**CSV, mode="PERMISSIVE", columnNameOfCorruptRecord="_record")
    path = F.col("_metadata.file_path")
    with settings(spark, many_small_files(spark)):
        found = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True).csv(paths)
        parsed = materialize(found.withColumns({S.KEY: X.id_from_path(path, id_rule), "_file": path}))
    if parsed.isEmpty():
        raise NoFiles(f"no records in {name_glob} files of {paths}")
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.RAW_FILE if f.name not in names]
    rows = parsed.filter(F.col("_record").isNull()).select(*names, *absent, S.KEY).select(*S.OBSERVATIONS.names)
    rejects = parsed.filter(F.col("_record").isNotNull()).select(S.KEY, F.col("_file").alias("file"), F.col("_record").alias("record"))
    return rows, rejects


def observation_table(spark, path, batch=None):
    """A merged observation table: a folder of Parquet or, by suffix of the path, CSV."""
    path = f"{path}/{batch}" if batch else path
    if path.rstrip("/").endswith("csv"):
        return spark.read.schema(S.OBSERVATIONS).option("header", True).csv(path)
    return spark.read.schema(S.OBSERVATIONS).parquet(path)


def first_rows(df, n, order=(S.KEY, S.HOUR)):
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def json_table(spark, path, schema):
    """A saved profile, metrics or result table."""
    return spark.read.schema(schema).json(path)


def files(spark, folder, glob="*"):
    """Path, size and time of every file below a folder; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return listing.option("pathGlobFilter", glob).load(folder).drop("content")


def content_hashes(spark, folder, glob="*"):
    """MD5 of the content of every file."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return listing.option("pathGlobFilter", glob).load(folder).select("path", F.md5("content").alias("md5"))


def count_contents(spark, folder, glob="*"):
    """Number of files and of distinct contents among them."""
    return content_hashes(spark, folder, glob).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("md5").alias("n_contents")
    )


def other_files(spark, folder, suffix=".psv"):
    """Folder and name of every file without the suffix, as rows."""
    paths = files(spark, folder).filter(~F.col("path").endswith(suffix))
    return paths.select(
        F.regexp_extract("path", r"^(.*)/", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
    )


def latest_run(spark, folder):
    """(path, folder name, stamp) of the newest model-run-<date>-<time> below a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(folder)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    # folder names only: one per model run
    names = [s.getPath().toString() for s in system.listStatus(base)] if system.exists(base) else []
    runs = spark.createDataFrame([(n,) for n in names], "path string")
    found = (
        runs.withColumns({"stamp": X.run_stamp("path"), "run": X.run_folder("path")})
        .filter(F.col("stamp").isNotNull())
        .agg(F.max_by("path", "stamp").alias("path"), F.max_by("run", "stamp").alias("run"), F.max("stamp").alias("stamp"))
        .first()
    )
    if found["stamp"] is None:
        raise NoFiles(f"no model run in {folder}")
    return found


def profile_or_new(spark, df, folder):
    """The saved profile of a folder; built from df and saved first where there is none."""
    from wardflow.operators import profile as R
    from wardflow.sources import writers

    if not writers.exists(spark, f"{folder}/statistics"):
        numeric, text = S.numeric_columns(df), S.text_columns(df, skip=(S.KEY,))
        writers.save_json(R.profile_numeric(df, numeric), f"{folder}/statistics")
        values = R.profile_values(df, text) if text else spark.createDataFrame([], S.PROFILE_VALUES)
        writers.save_json(values, f"{folder}/values")
        writers.save_json(R.recorded_schema(df), f"{folder}/schema")
    return {
        "schema": json_table(spark, f"{folder}/schema", "position int, column_name string, dtype string"),
        "statistics": json_table(spark, f"{folder}/statistics", S.PROFILE_STATS),
        "values": json_table(spark, f"{folder}/values", S.PROFILE_VALUES),
    }


