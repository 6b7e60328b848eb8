"""Streaming jobs over files that keep arriving: ingest, scoring, drift findings, latency windows."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.functions import scalars as X
from wardflow.operators import mergeable
from wardflow.operators import metrics as M
from wardflow.operators import profile as R
from wardflow.operators import validate as V
from wardflow.sources import writers
from wardflow.sources.readers import CSV
from wardflow.sources.requests import checked_requests, refused, rows_of


def file_stream(spark, folder, schema=S.RAW_FILE, fmt="csv", glob=None, files_per_batch=1000, **options):
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.options(**CSV)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.options(**options).load(folder)


def patient_stream(spark, folder, files_per_batch=1000):
    """Patient files as they land. A file is never cut, so a micro-batch holds whole patients."""
    rows = file_stream(spark, folder, glob="*.psv", files_per_batch=files_per_batch)
    return rows.withColumn(S.KEY, X.id_from_path(F.col("_metadata.file_path")))


def _run(writer, checkpoint):
    """Process what is there and stop; the checkpoint remembers it for the next start."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(stream, out, checkpoint):
    """Append new rows to a Parquet table; each file exactly once, also after a restart."""
    return _run(stream.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def per_batch(stream, work, out, checkpoint):
    """Call work(batch, save, number) on every micro-batch; save(name, df) writes and re-reads a table of it.

    Each table has one folder per batch. A batch that is repeated after a failure
    overwrites its folders, so nothing doubles.
    """

    def write(batch, batch_id):
        def save(name, df):
            path = f"{out}/{name}/run={batch_id}"
            writers.save_table(df, path)
            return batch.sparkSession.read.parquet(path)

        work(batch, save, batch_id)

    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def score_stream(stream, score, out, checkpoint):
    """Score request lines: tables `scored`, `rejects`, `log` and, if score lists them, `anomalies` below `out`.

    Each batch is parsed once, into the table `parsed`, from which rows and refusals are taken.
    Refused lines keep their body, so they can be sent again once they are mended.

    score(rows) returns the rows with a prediction and their other columns. Latency is
    the time from the arrival of a line (column arrived) to its scoring. The parsed rows go,
    as received and with the time of writing, to the request log (request_log), from which
    the batch is scored; a repeated batch is in it once.
    """

    def work(lines, save, number):
        # a file is one task of the scan up to the size of a Parquet row group, however long its lines take
        # to parse, so they are dealt out first; by a hash of the line, as a request may have any number of them
        tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lines.repartition(tasks, F.xxhash64("request", "value"))
        checked = save("parsed", checked_requests(dealt, keep=["arrived"]))  # lines are parsed here only
        save("rejects", refused(checked, keep=["arrived", F.col("_body").alias("value")]))
        rows = rows_of(checked, keep=["arrived"])
        logged = request_log(lines.sparkSession, out).append(rows.withColumn("created_at", F.current_timestamp()), number)
        seconds = F.current_timestamp().cast("double") - F.col("arrived").cast("double")
        scored = score(logged.drop("created_at"))
        scored = save("scored", scored.withColumns({"latency": seconds, "created_at": F.current_timestamp()}))
        save("log", M.scoring_log(scored, "request", "latency", "arrived"))
        if "anomalies" in scored.columns:
            save("anomalies", scored.select("request", F.inline("anomalies")).distinct())

    return per_batch(stream, work, out, checkpoint)


def request_log(spark, out):
    """The log of request rows that score_stream keeps below `out`."""
    return writers.BatchLog(spark, f"{out}/requests")


def drift_stream(stream, profile, out, checkpoint, skip=(S.LABEL,)):
    """Findings against a saved profile, of every micro-batch and of all rows so far.

    A batch is read once, into a mergeable profile. `findings` are those of the batch by itself;
    `state` is the profile of this and all earlier batches, and `findings_so_far` what it
    shows, so the newest of these do not depend on how files fall into batches. The state of a
    repeated batch is made again from the state before it.
    """

    def work(batch, save, number):
        spark, columns = batch.sparkSession, {c: F.col(c) for c in batch.columns if c not in skip}
        if S.KEY in columns:  # of the key only whether it is there
            columns[S.KEY] = F.when(F.col(S.KEY).isNotNull(), F.lit(""))
        part = save("part", mergeable.parts(batch.select(*[x.alias(c) for c, x in columns.items()])))
        earlier = [n for n in batch_numbers(spark, f"{out}/state") if n < number]
        state = part
        if earlier:
            before = spark.read.schema(part.schema).parquet(f"{out}/state/run={max(earlier)}")
            state = mergeable.merged(before.unionByName(part))
        state = save("state", state)
        for name, known in (("findings", part), ("findings_so_far", state)):
            save(name, V.monitor_parts(known, R.recorded_schema(batch), profile, skip))

    return per_batch(stream, work, out, checkpoint)


def batch_numbers(spark, folder):
    """Numbers of the batches that have a table below the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return [int(n.split("=")[1]) for n in names if n.startswith("run=")]


def drift_so_far(spark, out):
    """Findings of drift_stream in all rows up to its newest batch."""
    newest = max(batch_numbers(spark, f"{out}/findings_so_far"))
    return spark.read.parquet(f"{out}/findings_so_far/run={newest}")


def latency_windows(log, width="1 hour", delay="1 hour"):
    """Requests, rows and latency per time window of a log stream; late rows wait for `delay`."""
    return (
        log.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("n_input_rows").alias("rows"),
            F.sum("total_latency").alias("total_latency"),
            F.max("total_latency").alias("max_latency"),
        )
        .select("window.start", "window.end", "requests", "rows", "total_latency", "max_latency")
    )


def run_windows(windows, out, checkpoint):
    """Append closed windows to a table."""
    return _run(windows.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)
