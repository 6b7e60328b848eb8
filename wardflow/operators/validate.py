"""Checks of a table against a recorded profile. Every check yields findings as rows."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.joins import symmetric_difference

NUMERIC_NAMES = ["float64", "int64"]  # fixed values: accepted types of Age


def schema_findings(actual, expected, skip=(), first_only=False):
    """Missing columns and type differences, severity error.

    Both sides are (position, column_name, dtype) tables. first_only keeps the
    earliest finding in recorded order.
    """
    seen = actual.select("column_name", F.col("dtype").alias("observed"))
    both = expected.filter(~F.col("column_name").isin(*skip)) if skip else expected
    both = both.join(seen, "column_name", "left")
    age = F.col("column_name") == "Age"
    rule = F.when(F.col("observed").isNull(), "missing_column").when(
        F.when(age, ~F.col("observed").isin(*NUMERIC_NAMES)).otherwise(F.col("observed") != F.col("dtype")),
        "wrong_type",
    )
    wanted = F.when(age, F.lit(" or ".join(NUMERIC_NAMES))).otherwise(F.col("dtype"))
    findings = both.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    if first_only:
        findings = findings.orderBy("position").limit(1)
    return findings.select(
        "rule", "column_name", F.lit("error").alias("severity"), wanted.alias("expected"), "observed"
    )


def stat_findings(observed, recorded, skip=(), rates=False):
    """Range, mean, median and null findings from two numeric profiles.

    A recorded column that is not observed is a finding; one that is new is not.

    rates compares null shares in place of null counts.
    """
    o, r = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"r.{c}"))
    pairs = recorded.alias("r").join(observed.alias("o"), "column_name", "full")
    if skip:
        pairs = pairs.filter(~F.col("column_name").isin(*skip))

    def nulls(side):
        return F.try_divide(side("null_count"), side("n_rows")) if rates else side("null_count").cast("double")

    def far(stat):
        return F.abs(o(stat) - r(stat)) > 3 * r("std")

    has_range = r("min").isNotNull() & r("max").isNotNull()
    checks = [
        ("min", has_range & (o("min") < r("min")), r("min"), o("min")),
        ("max", has_range & (o("max") > r("max")), r("max"), o("max")),
        ("mean", far("mean"), r("mean"), o("mean")),
        ("median", far("median"), r("median"), o("median")),
        ("null_rate" if rates else "null_count", nulls(o) > nulls(r), nulls(r), nulls(o)),
        ("missing_statistics", o("n_rows").isNull() & r("n_rows").isNotNull(), r("n_rows").cast("double"), o("n_rows").cast("double")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.coalesce(failed, F.lit(False)).alias("failed"),
                expected.alias("expected"),
                found.alias("observed"),
            )
            for rule, failed, expected, found in checks
        ]
    )
    return (
        pairs.select("column_name", F.inline(rows))
        .filter("failed")
        .select("rule", "column_name", F.lit("warning").alias("severity"), "expected", "observed")
    )


def value_findings(observed, recorded, skip=()):
    """Text columns whose sets of distinct values differ, by a full join of the value tables."""
    both = (
        recorded.select("column_name", "value", F.lit(1).alias("_r"))
        .join(observed.select("column_name", "value", F.lit(1).alias("_o")), ["column_name", "value"], "full")
    )
    if skip:
        both = both.filter(~F.col("column_name").isin(*skip))
    return (
        both.groupBy("column_name")
        .agg(
            F.count("_r").cast("double").alias("expected"),
            F.count("_o").cast("double").alias("observed"),
            F.count_if(F.col("_r").isNull() | F.col("_o").isNull()).alias("_differ"),
        )
        .filter("_differ > 0")
        .select(
            F.lit("unique_values").alias("rule"),
            "column_name",
            F.lit("warning").alias("severity"),
            "expected",
            "observed",
        )
    )


def null_key_findings(df, key=S.KEY):
    """An error when any key is null."""
    lost = df.agg(F.count_if(F.col(key).isNull()).cast("double").alias("observed")).filter("observed > 0")
    return _null_key(lost, key)


def _null_key(lost, key):
    return lost.select(
        F.lit("null_key").alias("rule"),
        F.lit(key).alias("column_name"),
        F.lit("error").alias("severity"),
        F.lit(0.0).alias("expected"),
        "observed",
    )


def as_text(findings):
    """Numeric findings with expected and observed as text, to sit beside schema findings."""
    if dict(findings.dtypes)["expected"] != "double":
        return findings
    shown = {c: F.round(F.col(c), 6).cast("string") for c in ("expected", "observed")}
    return findings.withColumns(shown)


def all_findings(*tables):
    result = as_text(tables[0])
    for t in tables[1:]:
        result = result.unionByName(as_text(t))
    return result


def request_anomalies(df, recorded, columns, limit=300.0, legacy_sign=False, request=None):
    """Columns of a request whose mean or deviation is more than `limit` percent off.

    With the name of a request column, each request of df is checked by itself and the
    findings carry it; without one, df is a single request.

    The recorded value divides by size; legacy_sign divides by the signed value, so a
    negative recorded mean never alarms. A recorded 0 alarms when there is any
    difference. Columns without a value in the request are skipped.
    """
    keys = [request] if request else []
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}__std") for c in columns],
    )
    observed = stats.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"{c}__mean").alias("mean"),
                        F.col(f"{c}__std").alias("std"),
                    )
                    for c in columns
                ]
            )
        )
    ).filter(F.col("mean").isNotNull())
    # one row per column
    pairs = observed.alias("o").join(F.broadcast(recorded).alias("r"), "column_name")

    def percent(stat):
        gap = F.abs(100.0 * (F.col(f"r.{stat}") - F.col(f"o.{stat}")))
        base = F.col(f"r.{stat}") if legacy_sign else F.abs(F.col(f"r.{stat}"))
        at_zero = F.when((F.col(f"r.{stat}") == 0) & (gap > 0), float("inf"))
        return F.coalesce(F.try_divide(gap, base), at_zero)

    return pairs.select(
        *[F.col(f"o.{k}") for k in keys], "column_name", percent("mean").alias("mean_percent"), percent("std").alias("std_percent")
    ).filter((F.col("mean_percent") > limit) | (F.col("std_percent") > limit))


def request_column_findings(requests, expected, columns="columns"):
    """Names that are in the request or in the recorded schema, but not in both."""
    names = F.array(*map(F.lit, expected))
    return requests.withColumn("unexpected", symmetric_difference(names, F.col(columns))).filter(
        F.size("unexpected") > 0
    )


def model_drift(metrics, old="old_recall", new="new_recall", warn=3.0, retrain=5.0):
    """Recall lost in percent of the old recall, and what to do about it."""
    lost = F.try_divide(100.0 * (F.col(old) - F.col(new)), F.col(old))
    decision = F.when(lost > retrain, "retrain").when(lost > warn, "warn").otherwise("keep")
    return metrics.withColumns({"recall_change": lost, "decision": decision})


def next_action(findings, path, strict=False):
    """One row with the next step: alert on errors, else the batch or the first-run branch."""
    bad = F.count_if(F.lit(True) if strict else F.col("severity") == "error")
    passed = "score_batch" if "batch" in path else "split"
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        bad.alias("blocking"),
        F.when(bad > 0, "alert").otherwise(passed).alias("action"),
    )


def next_batch(batches, column="batch", last=3):
    """Batch number, following batch, and whether to run it or stop after the last one."""
    number = F.regexp_extract(F.coalesce(F.col(column), F.lit("batch-1")), r"(\d+)$", 1).cast("bigint")
    return batches.withColumns(
        {
            "number": number,
            "next_batch": F.concat(F.lit("batch-"), (number + 1).cast("string")),
            "state": F.when(number > last, "stop").otherwise("run"),
        }
    )


def alert_text(findings, job, title="Validation of schema and statistics failed"):
    """One line of text per finding, with the job name and a heading, for whoever sends it."""
    line = F.format_string(
        f"{title} [{job}] %s: column %s, rule %s, expected %s, observed %s",
        "severity", "column_name", "rule",
        F.coalesce("expected", F.lit("nothing")), F.coalesce("observed", F.lit("nothing")),
    )
    return as_text(findings).select("rule", "column_name", line.alias("message"))


def monitor(df, recorded_schema, recorded_stats, recorded_values, skip=(S.LABEL,)):
    """All findings of a table against a recorded profile, errors and warnings together."""
    from wardflow.operators import profile as P

    numeric = [c for c in S.numeric_columns(df, skip=(S.KEY, *skip))]
    text = S.text_columns(df, skip=(S.KEY, *skip))
    parts = [
        schema_findings(P.recorded_schema(df), recorded_schema, skip),
        null_key_findings(df) if S.KEY in df.columns else None,
        stat_findings(P.profile_numeric(df, numeric), recorded_stats, skip) if numeric else None,
        value_findings(P.profile_values(df, text), recorded_values, (S.KEY, *skip)) if text else None,
    ]
    return all_findings(*[p for p in parts if p is not None])


def monitor_parts(parts, schema, profile, skip=(S.LABEL,), key=S.KEY):
    """Findings as of monitor, from a mergeable profile (operators.mergeable) and a schema.

    Medians are near ones (see mergeable); everything else is exact.
    """
    from wardflow.operators import mergeable

    statistics = mergeable.statistics(parts, schema).filter(F.col("column_name") != key)
    lost = parts.filter((F.col("column_name") == key) & F.col("value").isNull() & F.col("bucket").isNull())
    lost = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("observed")).filter("observed > 0")
    ignored = (key, *skip)
    recorded = profile["statistics"].filter(F.col("column_name") != key)
    return all_findings(
        schema_findings(schema, profile["schema"], skip),
        _null_key(lost, key),
        stat_findings(statistics, recorded, skip),
        value_findings(mergeable.values(parts), profile["values"], ignored),
    )
