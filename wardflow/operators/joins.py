"""Joins and set operations on observation tables."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.ordered import running_totals
from wardflow.session import materialize


def rows_of(df, ids, key=S.KEY):
    """Rows whose key is in `ids`. No hint: the planner broadcasts ids only if they are small."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def leakage(left, right, key=S.KEY):
    """One row: does any key occur on both sides, asked from each side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    forth = a.join(b, key, "left_semi").select(F.lit(1).alias("l"), F.lit(0).alias("r"))
    back = b.join(a, key, "left_semi").select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    return forth.unionByName(back).agg(
        (F.coalesce(F.sum("l"), F.lit(0)) > 0).alias("left_in_right"),
        (F.coalesce(F.sum("r"), F.lit(0)) > 0).alias("right_in_left"),
        F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("shared_keys"),
    )


def with_labels(features, labels, keys=(S.KEY, S.HOUR)):
    """Features and label by their shared unique keys."""
    return features.join(labels, list(keys))


def absent(expected, present, on):
    """Rows of `expected` without a partner in `present`."""
    return expected.join(present.select(on).distinct(), on, "left_anti")


def append_batch(existing, batch):
    """Rows of both, matched by column name; a column missing on one side is null there."""
    return existing.unionByName(batch, allowMissingColumns=True)


def symmetric_difference(a, b):
    """Sorted elements that are in only one of two arrays."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def sets_differ(a, b):
    return F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b))


def label_encode(df, column, name):
    """Codes 0..k-1 in text order. The code table is joined without a hint, so its size decides."""
    values = materialize(df.select(column).filter(F.col(column).isNotNull()).distinct())
    codes = running_totals(values, [column], position="_code")
    coded = df.join(codes, column, "left")
    return coded.withColumn(name, (F.col("_code") - 1).cast("bigint")).drop("_code")
