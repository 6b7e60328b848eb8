"""A profile that can be merged: one row per column and bucket of numbers, or per text value.

Numbers fall into buckets whose borders grow by GAMMA, so a bucket's mean is within that share of
each of its numbers, and a column has at most a few thousand buckets for usual data and under
1.6 million for all doubles there are. Buckets do not depend on the data, so profiles of parts
add up to the profile of the whole, whichever way it was cut.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow import schema as S

GAMMA = 1.001
#: Above the bucket of the smallest positive double, so that positive buckets are above 0.
_SHIFT = 800_000


def _bucket(x):
    size = F.least(F.greatest(F.ceil(F.log(F.abs(x)) / math.log(GAMMA)), F.lit(-_SHIFT + 1)), F.lit(_SHIFT)) + _SHIFT
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.signum(x).cast("bigint") * size.cast("bigint"))


def parts(df):
    """Mergeable profile of the numeric and text columns of df, in one scan and one shuffle.

    Columns: column_name, bucket, value, n, total, spread (sum of squared distances from the mean
    of the row), lo, hi. Nulls, and NaN, are the row of a column without bucket and value.
    """
    numeric, text = S.numeric_columns(df), S.text_columns(df)
    cells = []
    for c in numeric:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        cells.append(F.struct(F.lit(c).alias("column_name"), x.alias("x"), F.lit(None).cast("string").alias("value")))
    for c in text:
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("x"), F.col(c).alias("value")))
    rows = df.select(F.inline(F.array(*cells)))
    return rows.groupBy("column_name", _bucket(F.col("x")).alias("bucket"), "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("total"),
        (F.var_pop("x") * F.count("x")).alias("spread"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    )


def _moments():
    """Count, total and spread of several rows of parts about their common mean."""
    n, total = F.sum("n"), F.sum("total")
    # total / n of a row, weighted by n: the distances of the rows' means from the common one
    apart = F.sum(F.col("total") * F.col("total") / F.col("n")) - total * total / n
    return n, total, F.sum("spread") + F.greatest(apart, F.lit(0.0))


def merged(several):
    """One profile of the union of several."""
    n, total, spread = _moments()
    return several.groupBy("column_name", "bucket", "value").agg(
        n.alias("n"), total.alias("total"), spread.alias("spread"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def values(profile):
    """Distinct values of the text columns with their counts, as of profile.profile_values."""
    return profile.filter(F.col("value").isNotNull()).select("column_name", "value", "n")


def statistics(profile, schema):
    """Rows as of profile.profile_numeric for the columns that schema (recorded_schema) calls numeric.

    The median is the mean of the bucket that holds it: within GAMMA - 1 of the true one, and
    the true one where its bucket has one number only.
    """
    kinds = schema.filter(~F.col("dtype").isin("object", "bool", "boolean")).select("column_name", "dtype")
    rows = profile.filter(F.col("value").isNull()).join(kinds, "column_name", "left_semi")
    known = rows.filter(F.col("bucket").isNotNull())
    # deviations are taken about the mean of the column: one row per column
    means = known.groupBy("column_name").agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_mean"))
    gap = F.col("total") / F.col("n") - F.col("_mean")
    near = known.join(F.broadcast(means), "column_name")
    upto = F.sum("n").over(Window.partitionBy("column_name").orderBy("bucket"))
    near = near.withColumns({"_upto": upto, "_middle": F.col("total") / F.col("n")})

    def at(rank):
        return F.min_by("_middle", F.when(F.col("_upto") >= rank, F.col("_upto")))

    found = near.groupBy("column_name").agg(
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        F.first("_mean").alias("mean"),
        ((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("median"),
        F.sqrt(F.try_divide(F.sum(F.col("spread") + F.col("n") * gap * gap), F.first("_n") - 1)).alias("std"),
    )
    counts = rows.groupBy("column_name").agg(
        F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.sum("n").alias("n_rows")
    )
    names = ["min", "max", "mean", "median", "std", "null_count", "n_rows"]
    return counts.join(found, "column_name", "left").join(kinds, "column_name").select("column_name", "dtype", *names)
