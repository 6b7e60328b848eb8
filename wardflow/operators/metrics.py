"""Evaluation metrics as aggregates over (truth, prediction) rows."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.ordered import running_totals
from wardflow.session import materialize


def _inline(df, rows):
    return df.select(F.inline(F.array(*rows)))


def _cells(df, truth, guess):
    """(y_true, y_pred, n) of the pairs that occur, nulls among them: one aggregate, combined on the map side."""
    return df.groupBy(F.col(truth).alias("y_true"), F.col(guess).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def _labels(cells, classes):
    """The classes as rows: those listed, else all in the cells; 0 and 1 are always among them
    where nothing else is."""
    found = cells.select(F.explode(F.array("y_true", "y_pred")).alias("label")).filter("label is not null").distinct()
    kind = found.schema["label"].dataType
    if classes is not None:
        rows = cells.sparkSession.createDataFrame([(c,) for c in classes], "label " + ("string" if kind.typeName() == "string" else "bigint"))
        return rows.select(F.col("label").cast(kind))
    if kind.typeName() == "string":
        return found
    only = F.coalesce(F.every(F.col("label").isin(0, 1)), F.lit(True))
    pair = found.agg(only.alias("only")).filter("only").select(F.explode(F.array(F.lit(0).cast(kind), F.lit(1).cast(kind))).alias("label"))
    return found.unionByName(pair).distinct()


def confusion_matrix(df, truth, guess, classes=None):
    """All (truth, prediction) pairs of the classes with their counts.

    Without a list of classes, both columns give them. The pairs that occur are counted, and
    the result, a row for every pair of classes, is filled up with zeros.
    """
    cells = _cells(df, truth, guess)
    labels = _labels(cells, classes)
    pairs = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    return pairs.join(cells, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(df, truth, guess, classes=None):
    """Per class: support, hits, precision, recall, f1; 0 where a denominator is 0.

    Works on the pairs that occur, so there may be any number of classes. Rows without a
    truth or a prediction, or with one that is not listed, do not count.
    """
    cells, n, zero = _cells(df, truth, guess), F.col("n"), F.lit(0).cast("bigint")
    labels = _labels(cells, classes)
    known = cells.filter("y_true is not null and y_pred is not null")
    if classes is not None:
        known = known.filter(F.col("y_true").isin(*classes) & F.col("y_pred").isin(*classes))
    sides = known.select(
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("label"), n.alias("s"), zero.alias("p"),
                         F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(0).alias("t")),
                F.struct(F.col("y_pred").alias("label"), zero.alias("s"), n.alias("p"), zero.alias("t")),
            )
        )
    )
    sides = sides.unionByName(labels.select("label", zero.alias("s"), zero.alias("p"), zero.alias("t")))
    per_class = sides.groupBy("label").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits")
    )
    return per_class.select(
        "label",
        "support",
        "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1_score"),
    )


def accuracy(df, truth, guess):
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def weighted_metrics(df, truth, guess, classes=None):
    """Accuracy and support-weighted precision, recall and f1 in one row."""
    total = F.sum("support")

    def weighted(c):
        return _ratio(F.sum(F.col(c) * F.col("support")), total).alias(c)

    return class_metrics(df, truth, guess, classes).agg(
        _ratio(F.sum("hits"), total).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1_score"),
    )


def binary_metrics(df, truth, guess):
    """Precision, recall and f1 of the positive class."""
    return class_metrics(df, truth, guess).filter("label = 1").select("precision", "recall", "f1_score")


def classification_report(df, truth, guess, classes=None):
    """One row per class, then accuracy, macro average and weighted average."""
    per_class = class_metrics(df, truth, guess, classes)
    total = F.sum("support")
    names = ("precision", "recall", "f1_score")
    overall = _ratio(F.sum("hits"), total)
    summary = per_class.agg(
        F.struct(
            F.lit("accuracy").alias("label"), *[overall.alias(c) for c in names], total.alias("support")
        ).alias("a"),
        F.struct(
            F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], total.alias("support")
        ).alias("m"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names],
            total.alias("support"),
        ).alias("w"),
    )
    rows = per_class.select(F.col("label").cast("string").alias("label"), *names, "support")
    return rows.unionByName(_inline(summary, ["a", "m", "w"]))


def _by_score(df, label, score, positive):
    hit = F.col(label) == positive
    counted = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(hit).alias("_pos"), F.count_if(~hit).alias("_neg"))
    )
    return materialize(counted)  # the curve reads it several times


def roc_points(df, label, score, positive=1):
    """Threshold, false and true positive rate for every distinct score, plus the origin.

    Equal scores form one point; a null or NaN score has no place and is left out. The
    running counts go through score ranges, so no task sees all distinct scores.
    """
    by_score = _by_score(df, label, score, positive)
    sizes = by_score.agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n")).first()
    curve = running_totals(
        by_score, [F.col("threshold").desc()], {"_tp": F.col("_pos"), "_fp": F.col("_neg")},
    )
    points = curve.select(
        "threshold",
        F.try_divide(F.col("_fp"), F.lit(sizes["n"])).alias("fpr"),
        F.try_divide(F.col("_tp"), F.lit(sizes["p"])).alias("tpr"),
    )
    origin = by_score.agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.count(F.lit(1)).alias("_n"),
    ).filter("_n > 0").drop("_n")
    return points.unionByName(origin)


def roc_auc(df, label, score, positive=1):
    """Area under the curve: each score's negatives times the positives ranked above them."""
    by_score = _by_score(df, label, score, positive)
    curve = running_totals(
        by_score, [F.col("threshold").desc()], {"_tp": F.col("_pos")}
    )
    area = F.sum((F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2)).cast("double"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return curve.agg(F.try_divide(area, pairs).alias("auc"))


def patient_verdict(df, prediction="prediction", key=S.KEY):
    """A patient is positive when any of their hours is."""
    return df.groupBy(key).agg(F.max(F.col(prediction).cast("int")).alias("prediction"))


def scoring_log(df, request, latency, stamp):
    """One row for each scored request: rows, first time, latency, latency per row.

    The predictions stay rows of their own table, so no log row grows with its request.
    """
    sizes = df.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_input_rows"),
        F.min(stamp).alias("timestamp"),
        F.max(latency).alias("total_latency"),
    )
    return sizes.withColumn("average_latency_per_row", F.try_divide(F.col("total_latency"), F.col("n_input_rows")))


def latency_summary(log):
    """Requests, rows and latency statistics over a scoring log."""
    return log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("n_input_rows").alias("rows"),
        F.sum("total_latency").alias("total_latency"),
        F.max("total_latency").alias("max_latency"),
        F.try_divide(F.sum("total_latency"), F.sum("n_input_rows")).alias("average_latency_per_row"),
    )


def grid_pivot(results, index, column, values, score, third=None):
    """Mean score by two parameters, one block of rows per value of a third."""
    keys = [third, index] if third else [index]
    return results.groupBy(*keys).pivot(column, list(values)).agg(F.avg(score))


def best_candidate(results, name, score):
    """Name with the highest score, null and NaN left out; the first in text order on ties."""
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    top = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("name")))
    return results.filter(usable).agg(top["name"].alias(name), (-top["s"]).alias(score))


def linear_contributions(df, coefficients, keys):
    """Per row: coefficient * (x - mean of x) for each feature."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    return df.select(
        *keys, *[(F.lit(float(b)) * (F.col(c) - F.lit(means[c]))).alias(c) for c, b in coefficients.items()]
    )


def mean_abs_contribution(contributions, columns):
    """Features by their mean absolute contribution."""
    sums = contributions.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return _inline(
        sums, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns]
    )
