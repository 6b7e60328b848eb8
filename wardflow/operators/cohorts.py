"""Cohorts of patients by positive counts, and assignments by ordered quotas."""

import math

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.ordered import running_totals
from wardflow.operators.sampling import hash_rank
from wardflow.session import materialize


def label_counts(df, key=S.KEY, label=S.LABEL):
    """Negative and positive rows of each patient, from one conditional aggregate."""
    return (
        df.filter(F.col(label).isin(0, 1))
        .groupBy(key)
        .agg(
            F.count_if(F.col(label) == 0).alias("count_of_0"),
            F.count_if(F.col(label) == 1).alias("count_of_1"),
        )
    )


def label_counts_joined(df, key=S.KEY, label=S.LABEL):
    """The same table by a full outer join of the two counts."""
    zero = df.filter(F.col(label) == 0).groupBy(key).agg(F.count(F.lit(1)).alias("count_of_0"))
    one = df.filter(F.col(label) == 1).groupBy(key).agg(F.count(F.lit(1)).alias("count_of_1"))
    return zero.join(one, key, "full").fillna(0, ["count_of_0", "count_of_1"])


def _by_count(counts):
    """One row per distinct positive count: patients with it, patients and positives above it."""
    levels = counts.groupBy("count_of_1").agg(F.count(F.lit(1)).alias("_patients"))
    positives = F.col("_patients") * F.col("count_of_1")
    order = [F.col("count_of_1").desc()]
    upto = running_totals(levels, order, {"_rank": F.col("_patients"), "_above": positives}, "_place")
    return upto.select(
        "count_of_1",
        "_patients",
        (F.col("_rank") - F.col("_patients")).alias("_rank"),
        (F.col("_above") - positives).alias("_above"),
    )


def running_positives(counts, key=S.KEY, seed="order"):
    """Rank and running positives, patients ordered by positives descending, then by hash.

    Within one positive count the running sum is arithmetic, so a global order needs
    only the table of distinct counts and the hash rank inside each count.
    """
    return _running(materialize(counts), key, seed)


def _running(counts, key, seed):
    ranked = hash_rank(counts, key, seed, "count_of_1", name="_in_level")
    levels = _by_count(counts).drop("_patients")
    return ranked.join(levels, "count_of_1").select(
        *counts.columns,
        (F.col("_rank") + F.col("_in_level")).alias("position"),
        (F.col("_above") + F.col("count_of_1") * F.col("_in_level")).alias("cumulative_count_of_1"),
    )


def _closing(levels, start, after, target):
    """First patient rank behind `after` at which positives counted from `start` reach `target`."""
    need = F.greatest(F.lit(target + start) - F.col("_above"), F.lit(0))
    steps = F.when(need <= 0, F.lit(0)).otherwise(F.ceil(F.try_divide(need, F.col("count_of_1"))))
    first = F.greatest(steps, F.lit(after + 1) - F.col("_rank"), F.lit(1))
    return (
        levels.filter(steps.isNotNull() & (first <= F.col("_patients")))
        .select(
            (F.col("_rank") + first).alias("rank"),
            (F.col("_above") + F.col("count_of_1") * first).alias("total"),
        )
        .orderBy("rank")
        .first()
    )


def threshold_cohorts(counts, key=S.KEY, shares=(0.7, 0.2), seed="order"):
    """Cohorts 1, 2, 3: each closes when its own positives reach its share of the total.

    What follows the first cohort stays in the second until that closes; everything
    after is the third. The borders come from the table of distinct positive counts.
    """
    counts = materialize(counts)  # read four times below
    levels = materialize(_by_count(counts))
    total = levels.agg(F.sum(F.col("count_of_1") * F.col("_patients"))).first()[0] or 0
    targets = [math.ceil(total * s) for s in shares]
    first = _closing(levels, 0, 0, targets[0])
    ordered = _running(counts, key, seed)
    cohort = F.lit(1)
    if first is not None:
        second = _closing(levels, first["total"], first["rank"], targets[1])
        later = F.lit(2) if second is None else F.when(F.col("position") <= second["rank"], 2).otherwise(3)
        cohort = F.when(F.col("position") <= first["rank"], 1).otherwise(later)
    return ordered.withColumn("cohort", cohort)


def quota_names(df, key, quotas, rest, name="destination"):
    """Distinct keys in order, the first quotas[0] to its name and so on, the others to `rest`.

    quotas: list of (name, count), as numbers.
    """
    keys = materialize(df.select(key).filter(F.col(key).isNotNull()).distinct())
    ranked = running_totals(keys, [key])
    upto, chosen = 0, None
    for target, count in quotas:
        upto += count
        test = F.col("position") <= upto
        chosen = F.when(test, target) if chosen is None else chosen.when(test, target)
    return ranked.withColumn(name, F.lit(rest) if chosen is None else chosen.otherwise(rest))


def chunks(df, order, size=500, name="chunk"):
    """Consecutive chunks of `size` rows in the given order, numbered from 0."""
    numbered = running_totals(df, order, position="_position")
    return numbered.withColumn(name, F.floor((F.col("_position") - 1) / size)).drop("_position")
