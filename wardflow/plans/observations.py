"""The observation table derived from the events table, used by the registered queries."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.ordered import MAX_ROWS, drop_parts, part_columns, row_position


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _keyed(spark, folder):
    """Events with their patient id."""
    e = table(spark, folder, "events")
    user = F.col("user_id").cast("string")
    digits = F.lpad(user, F.greatest(F.length(user), F.lit(6)), F.lit("0"))
    return e.select(F.concat(F.lit("p"), digits).alias(S.KEY), "user_id", "event_id", "event_type", "value", "ts")


def _numbered(spark, folder, max_rows):
    """Keyed events with the hour: the position among the events of the patient."""
    return row_position(_keyed(spark, folder), S.KEY, ["ts", "event_id"], max_rows, S.HOUR)


def _context():
    """The columns that every event of a user shares, and the label."""
    user = F.col("user_id")
    positive = (F.col("event_type") == "error") & (F.col("value") > 100)
    return {
        "Age": (20 + user % 70).cast("double"),
        "Gender": user % 3,
        "Unit1": (user % 2).cast("double"),
        "Unit2": (1 - user % 2).cast("double"),
        "HospAdmTime": (0 - user % 100).cast("double"),
        S.LABEL: F.when(positive, 1).otherwise(0).cast("bigint"),
    }


def observations(spark, folder, parts=False, max_rows=MAX_ROWS, hours=True):
    """One row per event, shaped as an hourly observation with a few sparse measurements.

    `parts` keeps the part columns so that a following gap fill works on the same
    partitioning. Without `hours` there is no hour, and no scan for long patients.
    """
    numbered = _numbered(spark, folder, max_rows) if hours else _keyed(spark, folder)
    kind, value = F.col("event_type"), F.col("value")
    measured = {
        "HR": F.when(kind == "view", value),
        "Temp": F.when(kind == "click", value),
        "MAP": F.when(kind == "purchase", value),
        "BUN": F.when(kind == "signup", value),
        "WBC": F.when(F.col("event_id") % 3 == 0, value),
        "Hct": F.when((kind == "signup") & (value > 100), value),
        "AST": F.when((kind == "error") & (F.col("event_id") % 10 == 0), value),
    }
    columns = [c.alias(name) for name, c in {**measured, **_context()}.items()]
    rows = numbered.select(S.KEY, *([S.HOUR] if hours else []), *columns, "ts", "event_id", *part_columns(numbered))
    return rows if parts else drop_parts(rows)


def raw_observations(spark, folder, max_rows=MAX_ROWS):
    """One row per event with all raw columns: measurement i is known in every third hour.

    The measurements are made as one array: an expression for each makes the generated code of a row
    one method of more than 8,000 bytes, which the JVM never compiles.
    """
    numbered = _numbered(spark, folder, max_rows)
    value = F.transform(
        F.array(*map(F.lit, range(len(S.MEASUREMENTS)))),
        lambda i: F.when((F.col("event_id") + i) % 3 == 0, F.round(F.col("value") + i, 2)),
    )
    numbered = numbered.withColumn("_measured", value)
    measured = {c: F.get("_measured", F.lit(i)) for i, c in enumerate(S.MEASUREMENTS)}
    columns = {**measured, **_context(), S.HOUR: F.col(S.HOUR), S.KEY: F.col(S.KEY)}
    raw = [columns[c].alias(c) for c in S.OBSERVATIONS.names]
    return numbered.select("event_id", *raw, *part_columns(numbered))
