"""Column profiles as tall tables: one row per column, one row per distinct value."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.functions.quantiles import exact_quantiles


def _inline(df, rows):
    return df.select(F.inline(F.array(*rows)))


def recorded_schema(df):
    """(position, column_name, dtype) of a table, from its plan alone."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, S.dtype_name(f.dataType)) for i, f in enumerate(df.schema)],
        "position int, column_name string, dtype string",
    )


def profile_numeric(df, columns=None, accuracy=10_000):
    """min, max, mean, median, sample deviation and null count of each numeric column."""
    columns = columns or S.numeric_columns(df)
    types = {f.name: S.dtype_name(f.dataType) for f in df.schema}
    found = exact_quantiles(
        df,
        columns,
        (0.5,),
        accuracy,
        {
            "n_rows": ("count(*)", "bigint"),
            "null_count": ("count_if({c} IS NULL)", "bigint"),
            "min": ("min({c})", "double"),
            "max": ("max({c})", "double"),
            "mean": ("avg({c})", "double"),
            "std": ("stddev_samp({c})", "double"),
        },
    )
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return found.select(
        "column_name",
        names[F.col("column_name")].alias("dtype"),
        "min",
        "max",
        "mean",
        F.col("value").alias("median"),
        "std",
        "null_count",
        "n_rows",
    )


def profile_text(df, columns=None):
    """Null count and number of distinct values of each text column."""
    columns = columns or S.text_columns(df)
    values = profile_values(df, columns)
    distinct = values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("_known")
    )
    rows = _inline(
        df.agg(F.count(F.lit(1)).alias("n_rows")),
        [F.struct(F.lit(c).alias("column_name"), F.col("n_rows")) for c in columns],
    )
    return rows.join(distinct, "column_name", "left").select(
        "column_name",
        F.lit("object").alias("dtype"),
        (F.col("n_rows") - F.coalesce("_known", F.lit(0))).alias("null_count"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "n_rows",
    )


def profile_values(df, columns=None):
    """Every distinct non-null value of the text columns with its count, as rows.

    Kept tall so that a column with very many values never becomes one array.
    """
    columns = columns or S.text_columns(df)
    return (
        df.select(*columns)
        .unpivot([], columns, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missing_counts(df, columns=None):
    """Columns that have nulls, with their number."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _inline(
        counts,
        [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns],
    ).filter("missing > 0")


def describe_exact(df, columns=None, accuracy=10_000):
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    columns = columns or S.numeric_columns(df)
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    stats = {
        "count": ("count({c})", "bigint"),
        "mean": ("avg({c})", "double"),
        "std": ("stddev_samp({c})", "double"),
        "min": ("min({c})", "double"),
        "max": ("max({c})", "double"),
    }
    found = exact_quantiles(df, columns, tuple(shares.values()), accuracy, stats)
    return (
        found.groupBy("column_name")
        .agg(
            *[F.max(s).alias(s) for s in stats],
            *[F.max(F.when(F.col("share") == q, F.col("value"))).alias(name) for name, q in shares.items()],
        )
        .select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def value_counts(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def prevalence(df, label=S.LABEL):
    """Rows of each class and the positive share, in one row."""
    positive = F.count_if(F.col(label) == 1)
    negative = F.count_if(F.col(label) == 0)
    return df.agg(
        positive.alias("positives"),
        negative.alias("negatives"),
        F.try_divide(positive, positive + negative).alias("prevalence"),
    )


def correlation(df, a, b):
    return df.agg(F.corr(a, b).alias("correlation"))


def shape(df):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def histogram(df, column, bins=10):
    """Equal bins between the extremes of the finite values, the last one closed, empty bins kept.

    Where there are NaN or infinite values, bin -1 without a lower border counts them; nulls
    are not counted.
    """
    x = F.col(column).cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    lo, hi = df.filter(~odd).agg(F.min(x), F.max(x)).first()
    width = (hi - lo) / bins if hi is not None else 0.0
    at = F.least(F.floor((x - F.lit(lo)) / width), F.lit(bins - 1)) if width else x * 0
    counts = df.select(F.when(odd, -1).when(x.isNotNull(), at).alias("_bin")).agg(
        *[F.count_if(F.col("_bin") == i).alias(f"n{i}") for i in range(-1, bins)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("bin"),
            (F.lit(lo).cast("double") + width * i if i >= 0 else F.lit(None).cast("double")).alias("lower"),
            F.col(f"n{i}").alias("n"),
        )
        for i in range(-1, bins)
    ]
    return _inline(counts, rows).filter("bin >= 0 OR n > 0")
