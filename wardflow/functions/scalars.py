"""Column expressions. All of them stay inside generated JVM code."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c):
    """NaN and both infinities become null, the only missing marker used here."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def log1p(c):
    """ln(1+x); null at and below -1, where no finite logarithm exists."""
    return F.log1p(F.col(c) if isinstance(c, str) else c)


def clipped_log(c, below=0.0):
    """ln(1 + max(x, below)); a null stays null although greatest() skips nulls."""
    c = F.col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(below))))


def mirrored_log(c, above=0.0):
    """ln(1 + (1 - min(x, above))): for columns that run to the negative side."""
    c = F.col(c)
    return F.when(c.isNotNull(), F.log1p(F.lit(1.0) - F.least(c.cast("double"), F.lit(above))))


def gender_letter(c="Gender"):
    """1 or 'M' is M, 0 or 'F' is F, anything else is null."""
    text = F.col(c).cast("string")
    return F.when(text.isin("1", "1.0", "M"), "M").when(text.isin("0", "0.0", "F"), "F")


def one_hot_gender(c="Gender"):
    """The int columns F and M; an unknown gender gives (0, 0)."""
    letter = gender_letter(c)
    return [
        F.coalesce((letter == "F").cast("int"), F.lit(0)).alias("F"),
        F.coalesce((letter == "M").cast("int"), F.lit(0)).alias("M"),
    ]


def id_from_path(path, rule="file_name"):
    """Patient id from a file path.

    file_name: name without the .psv suffix (p000002.psv -> p000002), null for other files.
    trimmed: name without its first two characters and suffix (-> 00002).
    after_p: text between the first p and the next dot or p (-> 000002).
    stem: name up to its last dot, or the whole name without one.
    folder: value of the folder Patient_ID=..., as partitioned writers name it.
    """
    path = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    if rule == "file_name":
        return F.nullif(F.regexp_extract(path, r"([^/]+)\.psv$", 1), F.lit(""))
    if rule == "trimmed":
        return F.substring(name, F.lit(3), F.greatest(F.length(name) - 6, F.lit(0)))
    if rule == "after_p":
        return F.split(F.split(name, "p").getItem(1), r"\.").getItem(0)
    if rule == "stem":
        return F.regexp_replace(name, r"\.[^.]*$", "")
    if rule == "folder":
        return F.nullif(F.regexp_extract(path, r"/Patient_ID=([^/]+)/", 1), F.lit(""))
    raise ValueError(f"unknown id rule {rule!r}")


def id_text(df, name):
    """Id as text: numbers without a fraction, text as it is, null as the empty string."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    whole = F.col(name).cast("bigint") if numeric else F.col(name)
    return F.coalesce(whole.cast("string"), F.lit(""))


def run_stamp(path):
    """Number made of the date and time digits of a model-run-<date>-<time> path, else null."""
    path = F.col(path) if isinstance(path, str) else path
    digits = F.concat(
        F.regexp_extract(path, r"model-run-(\d+)-(\d+)", 1),
        F.regexp_extract(path, r"model-run-(\d+)-(\d+)", 2),
    )
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def run_folder(path):
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"(model-run-\d+-\d+)", 1)


def model_version(path):
    """N of a name that ends in _v<N>.<suffix>, else null."""
    path = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(path, r"_v(\d+)\.[^.]*$", 1), F.lit("")).try_cast("bigint")


def null_text(c):
    """Text for display, with null shown as the word."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def row_json(columns):
    """The row as a JSON array, nulls kept in their places."""
    return F.to_json(
        F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}
    )


def percent_change(old, new):
    """100 * (old - new) / old; null where old is 0."""
    return F.try_divide(F.lit(100.0) * (old - new), old)


def is_unnamed(name):
    """True for index columns that a CSV writer left behind."""
    return re.match(r"(?i)^unnamed", name) is not None
