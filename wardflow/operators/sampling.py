"""Seeded exact sampling and splitting by hash order.

Order is md5(seed|key): the same rows on every layout of the data and on every
retry of a task. Ranks come from counts per hash prefix, so no task sorts the
table; samples of a given size need only one cut value per class, which turns
membership into a row-local comparison with no join on the sampled key.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow import schema as S

DIGITS = 4  # hash digits per bucket: 65,536 buckets per class
BUCKET = 1_000_000  # rows of a bucket that one task sorts for a cut


def hash_of(key, seed):
    """md5 of the seed and the key. Keys of several columns are told apart by the lengths of
    their parts, and null is not the empty text; a key of one column is its text."""
    if isinstance(key, str) or len(key) == 1:
        whole = F.col(key if isinstance(key, str) else key[0]).cast("string")
        return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(whole, F.lit(""))))
    parts = [F.col(c).cast("string") for c in key]
    return F.md5(F.concat(F.lit(f"{seed}|"), *[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts]))


def hash_rank(df, key, seed, by=(), digits=DIGITS, name="position", total=None):
    """1-based rank of each row in hash order inside each `by` group, and the group's size as `total`."""
    by = [by] if isinstance(by, str) else list(by)
    hashed = df.withColumn("_h", hash_of(key, seed))
    # a struct is never null, so null classes are a group of their own; the window and
    # the join below share one shuffle on it
    grouped = hashed.withColumn("_g", F.struct(*by, F.substring("_h", 1, digits).alias("_b")))
    sizes = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    classes = [F.col("_g")[c] for c in by]
    upto = W.partitionBy(*classes).orderBy(F.col("_g._b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_g").alias("_og"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*classes)).alias("_total"),
    )
    inside = W.partitionBy("_g").orderBy("_h")
    return (
        grouped.withColumn("_r", F.row_number().over(inside))
        .join(offsets, F.col("_g") == F.col("_og"))
        .select(
            *df.columns,
            (F.col("_r") + F.col("_before")).cast("bigint").alias(name),
            *([F.col("_total").alias(total)] if total else []),
        )
    )


def _hashed(df, key, seed, by):
    return df.select((F.col(by) if by else F.lit(0)).alias("_class"), hash_of(key, seed).alias("_h"))


def _cut_buckets(rows, quotas, digits):
    """(_class, _b, _k, _n) of the bucket that holds the cut of each class: its hash prefix,
    the wanted position in it and its size. quotas: (_class, quota)."""
    buckets = rows.groupBy("_class", F.substring("_h", 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(W.partitionBy("_class").orderBy("_b"))
    return (
        buckets.withColumn("_upto", running)
        .join(quotas, "_class")
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select("_class", "_b", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_k"), "_n")
    )


def _within(rows, cuts, digits):
    """The rows in the buckets of cuts, with the columns _k and _n of their class."""
    prefix = F.substring("_h", 1, digits)
    return rows.withColumn("_b", prefix).join(cuts, ["_class", "_b"])


def _quotas(rows, quota):
    totals = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("total"))
    return quota(totals).select("_class", F.least("quota", "total").alias("quota"))


def hash_cut_table(df, key, seed, quota, by, digits=DIGITS):
    """(_class, _h): hash value of the last sampled row of each class with a quota above 0, for
    any number of classes. A class has 16 ** digits buckets, and the one of its cut is sorted."""
    rows = _hashed(df, key, seed, by).filter("_class is not null")
    found = _within(rows, _cut_buckets(rows, _quotas(rows, quota), digits), digits)
    inside = W.partitionBy("_class").orderBy("_h")
    return found.withColumn("_r", F.row_number().over(inside)).filter("_r = _k").select("_class", "_h")


def hash_cuts(df, key, seed, quota, by=None, classes=(0,), digits=DIGITS, bucket=BUCKET):
    """Hash value of the last sampled row, for each listed class with a quota above 0.

    quota(totals) gets a small table (_class, total) and adds the column `quota`. Counts
    per hash prefix find the bucket that holds the cut; while it has more than `bucket` rows,
    it is counted again by a longer prefix. Only that bucket is sorted. What returns to the
    driver is one row per listed class and round.
    """
    spark, out = df.sparkSession, {}
    rows = _hashed(df, key, seed, by).filter(F.col("_class").isin(*classes))
    kind = rows.schema["_class"].dataType.simpleString()
    inside = W.partitionBy("_class").orderBy("_h")
    cuts = _cut_buckets(rows, F.broadcast(_quotas(rows, quota)), digits).collect()
    while cuts:
        table = F.broadcast(spark.createDataFrame(cuts, f"_class {kind}, _b string, _k bigint, _n bigint"))
        held, ready = _within(rows, table, digits), F.col("_n") <= bucket
        if digits >= 32:
            ready = F.lit(True)
        found = held.filter(ready).withColumn("_r", F.row_number().over(inside)).filter("_r = _k")
        out.update(tuple(r) for r in found.select("_class", "_h").collect())
        left = [r for r in cuts if r["_class"] not in out]
        if not left:
            break
        quotas = spark.createDataFrame([(r["_class"], r["_k"]) for r in left], f"_class {kind}, quota bigint")
        rows = held.filter(~ready).select("_class", "_h")
        digits = min(digits + DIGITS, 32)
        cuts = _cut_buckets(rows, F.broadcast(quotas), digits).collect()
    return out


def in_sample(cuts, key, seed, by=None):
    """True where the row's hash is within the cut of its class: a row-local test."""
    hashed = hash_of(key, seed)
    inside = F.lit(False)
    for cls, cut in cuts.items():
        within = hashed <= F.lit(cut)
        inside = inside | ((F.col(by) == cls) & within if by else within)
    return F.coalesce(inside, F.lit(False))


def share_of_total(share):
    def quota(totals):
        return totals.withColumn("quota", F.ceil(F.col("total") * F.lit(float(share))).cast("bigint"))

    return quota


def group_split(df, key=S.KEY, share=0.25, seed="split", name="side"):
    """Whole groups to 'test' (share of groups, rounded up) or 'train'."""
    groups = df.select(key).filter(F.col(key).isNotNull()).distinct()
    cuts = hash_cuts(groups, key, seed, share_of_total(share))
    return df.withColumn(name, F.when(in_sample(cuts, key, seed), "test").otherwise("train"))


def row_split(df, key, share=0.2, seed="42", name="side"):
    """Single rows to 'test' or 'train'; key must be unique."""
    cuts = hash_cuts(df, key, seed, share_of_total(share))
    return df.withColumn(name, F.when(in_sample(cuts, key, seed), "test").otherwise("train"))


def undersample(df, key, label=S.LABEL, ratio=2, seed="undersample"):
    """All positives and exactly ratio times as many negatives; fails when there are fewer."""

    def quota(totals):
        size = {v: F.sum(F.when(F.col("_class") == v, F.col("total"))) for v in (0, 1)}
        need = F.coalesce(size[1], F.lit(0)) * ratio
        short = F.raise_error(F.lit("fewer negatives than the sample needs")).cast("bigint")
        return totals.agg(
            F.lit(0).alias("_class"),
            F.when(F.coalesce(size[0], F.lit(0)) < need, short).otherwise(need).alias("quota"),
            F.coalesce(size[0], F.lit(0)).alias("total"),
        ).filter("quota > 0")

    cuts = hash_cuts(df, key, seed, quota, by=label, classes=(0, 1))
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & in_sample(cuts, key, seed, label)))


def largest_remainder(draws):
    """Quota per class in proportion to its size, summing to `draws` (a number or a column of n)."""

    def quota(totals):
        whole = F.sum("total").over(W.partitionBy())
        n = draws(whole) if callable(draws) else F.lit(draws)
        exact = F.col("total") * n / whole
        order = W.orderBy((F.col("_exact") - F.floor("_exact")).desc(), "_class")
        left = F.col("_draws") - F.sum(F.floor("_exact")).over(W.partitionBy())
        return (
            totals.withColumns({"_exact": exact, "_draws": n.cast("bigint")})
            .withColumn("_left", left)
            .withColumn(
                "quota",
                (F.floor("_exact") + (F.row_number().over(order) <= F.col("_left")).cast("int")).cast("bigint"),
            )
            .filter("quota > 0")
        )

    return quota


def stratified_sample(df, key, draws, by=S.LABEL, classes=None, seed="strata"):
    """Exactly `draws` rows with class shares kept, ties of remainders to the lower class.

    Without a list of classes, all in the data count, however many; their cuts are joined.
    """
    if classes is not None:
        return df.filter(in_sample(hash_cuts(df, key, seed, largest_remainder(draws), by=by, classes=classes), key, seed, by))
    cuts = hash_cut_table(df, key, seed, largest_remainder(draws), by)
    cuts = cuts.select(F.col("_class").alias("_cut_class"), F.col("_h").alias("_cut"))
    return df.join(cuts, F.col(by) == F.col("_cut_class")).filter(hash_of(key, seed) <= F.col("_cut")).drop("_cut_class", "_cut")


def assign_folds(df, key, folds=5, by=S.LABEL, seed="folds", name="fold"):
    """Fold number 0..folds-1; inside each class the fold sizes differ by at most one."""
    ranked = hash_rank(df, key, seed, [by] if by else [], name="_position")
    return ranked.withColumn(name, ((F.col("_position") - 1) % folds).cast("int")).drop("_position")


def equal_parts(df, key, parts=3, seed="parts", name="part"):
    """Near-equal parts in hash order, the first n % parts one row larger."""
    ranked = hash_rank(df, key, seed, name="_position", total="_total")
    n = F.col("_total")
    small = F.floor(n / parts)
    larger = n % parts
    at = F.col("_position") - 1
    part = F.when(at < larger * (small + 1), F.floor(at / (small + 1))).otherwise(
        larger + F.floor((at - larger * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn(name, (part + 1).cast("int")).drop("_position", "_total")
