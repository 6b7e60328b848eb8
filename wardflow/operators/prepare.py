"""Feature preparation: column pruning, gap fill, logs, one-hot, null drop, scaling."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.functions import scalars as X
from wardflow.operators.ordered import MAX_ROWS, drop_parts, fill_gaps, part_columns


def drop_redundant(df):
    return df.drop(*S.REDUNDANT)


def drop_sparse(df):
    return df.drop(*S.SPARSE)


def drop_unnamed(df):
    return df.select(*[c for c in df.columns if not X.is_unnamed(c)])


def add_unit(df):
    return df.withColumn("Unit", F.col("Unit1") + F.col("Unit2"))


def cast_declared(df):
    """Declared types by name; unreadable text becomes null, a null id the empty string."""
    types = {**{c: "double" for c in S.DOUBLE_COLUMNS}, **{c: "bigint" for c in S.LONG_COLUMNS}}
    casts = {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    if S.KEY in df.columns:
        casts[S.KEY] = X.id_text(df, S.KEY)
    return df.withColumns(casts)


def null_non_finite(df, columns=None):
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: X.finite(c) for c in names})


def fill_zero(df, columns=S.ZERO_FILLED):
    return df.fillna(0, [c for c in columns if c in df.columns])


def log_time_columns(df):
    """Logs of age, hour and admission offset in place of the columns themselves."""
    return df.withColumns(
        {
            "Age_log": X.clipped_log("Age"),
            "ICULOS_log": X.clipped_log(S.HOUR),
            "HospAdmTime_log": X.mirrored_log("HospAdmTime"),
        }
    ).drop("Age", S.HOUR, "HospAdmTime")


def prepare_features(df, key=S.KEY, order=(S.HOUR,), direction="both", keep=(), max_rows=MAX_ROWS):
    """Filled, logged, one-hot encoded rows without nulls; key, order and `keep` are carried.

    Works on any subset of the raw columns. Columns that cannot reach the result are
    pruned before the fill, so they are never read or shuffled.
    """
    carried = [key, *order, *[c for c in keep if c not in (key, *order)]]
    parts = part_columns(df)
    dropped = {c.lower() for c in S.REDUNDANT + S.SPARSE + ["Hour", "created_at"]}
    body = [
        c
        for c in df.columns
        if c not in carried and c not in parts and c.lower() not in dropped and not X.is_unnamed(c)
    ]
    rows = df.select(*carried, *parts, *body)
    filled = drop_parts(fill_gaps(rows, key, list(order), body, direction, max_rows))
    logged = filled.withColumns({c: X.log1p(c) for c in S.LOGGED if c in body})
    if "Gender" in body:
        logged = logged.select(*[c for c in logged.columns if c != "Gender"], *X.one_hot_gender())
    return logged.na.drop(subset=[c for c in logged.columns if c not in keep])


def features_in(df):
    """Feature columns present, in the order of the feature vector."""
    return [c for c in S.FEATURES if c in df.columns]


def to_feature_order(df, carried=(S.KEY, S.LABEL)):
    names = features_in(df)
    return df.select(*[c for c in carried if c in df.columns and c not in names], *names)


def scaler_fit(df, columns=None):
    """One row per scaled column with its mean and population deviation."""
    columns = columns or [c for c in S.SCALED if c in df.columns]
    stats = df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )
    return stats.select(
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
    )


def fitted_values(table):
    """{column_name: row} of a fitted table, which has one row per column."""
    return {r["column_name"]: r for r in table.collect()}


def scaler_apply(df, fitted, columns=None):
    """(x - mean) / std with stored parameters; a deviation of 0 counts as 1."""
    rows = fitted_values(fitted)
    columns = columns or [c for c in S.SCALED if c in df.columns]
    return df.withColumns(
        {c: (F.col(c) - F.lit(rows[c]["mean"])) / F.lit(rows[c]["std"] or 1.0) for c in columns}
    )


def mean_fit(df, columns):
    return df.agg(*[F.avg(c).alias(c) for c in columns]).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean")) for c in columns]
            )
        )
    )


def mean_apply(df, fitted, columns):
    """Fill nulls with means that were fitted on this or on other data."""
    rows = fitted_values(fitted)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(rows[c]["mean"])) for c in columns})
