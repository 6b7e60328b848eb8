"""Ordered work inside keys and over whole tables, without a task that holds a whole key.

A window over `partitionBy(patient)` puts a patient into one task, and a window
without partitioning puts the table into one. The operators here first measure: a
small enough group keeps the plain window. Larger groups are cut into consecutive
parts, the work runs inside each part, and the little that crosses part borders
(counts, sums, last seen values) goes through a table with one row per part.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.session import materialize

MAX_ROWS = 1_000_000  # rows of one group that a single task may sort
PART, HOT = "_part", "_hot"


def split_hot(df, key, order, max_rows=MAX_ROWS):
    """Add `_part`, so that (key, _part) groups hold max_rows rows at most and follow `order`.

    One aggregate looks for keys with more rows. Without any, `_part` is the constant 0.
    Otherwise the rows of hot keys are numbered in the order of (key, *order), and every
    max_rows numbers are a part; `_hot` marks them. Equal rows are cut apart as well, so
    the bound holds for every distribution of the order columns.
    """
    order = [order] if isinstance(order, str) else list(order)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = materialize(sizes.select(F.col(key).alias("_key")))
    if hot.isEmpty():
        return df.withColumn(PART, F.lit(0).cast("bigint"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    numbered = running_totals(df.join(hot, same, "left_semi"), [key, *order], position="_at")
    cut = numbered.withColumn(PART, (F.floor((F.col("_at") - 1) / max_rows) + 1).cast("bigint")).withColumn(HOT, F.lit(True))
    rest = df.join(hot, same, "left_anti").withColumn(PART, F.lit(0).cast("bigint")).withColumn(HOT, F.lit(False))
    return rest.unionByName(cut.drop("_at"))


def row_position(df, key, order, max_rows=MAX_ROWS, name="position"):
    """1-based row number inside key, in the order of the given columns.

    The part columns stay on the result so that later steps reuse the partitioning.
    """
    if PART not in df.columns:
        df = split_hot(df, key, order, max_rows)
    inside = F.row_number().over(W.partitionBy(key, PART).orderBy(*order))
    numbered = df.withColumn(name, inside.cast("bigint"))
    if HOT not in df.columns:
        return numbered
    sizes = df.filter(HOT).groupBy(key, PART).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy(PART)) - F.col("_n")
    offsets = materialize(sizes.select(key, PART, before.alias("_before")))
    return (
        numbered.join(offsets, [key, PART], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*numbered.columns)
    )


def part_columns(df):
    return [c for c in (PART, HOT) if c in df.columns]


def drop_parts(df):
    return df.drop(PART, HOT)


def fill_gaps(df, key, order, columns, direction="both", max_rows=MAX_ROWS):
    """Fill nulls inside each key: from the next known value, then from the previous one.

    direction="forward" uses earlier values only. `order` must be unique inside the
    key. Rows without a key are dropped. Both scans are running `last` values (one
    per direction), linear in the group; hot keys also take the nearest known value
    of their other parts.
    """
    if direction not in ("both", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    df = df.filter(F.col(key).isNotNull())
    if PART not in df.columns:
        df = split_hot(df, key, order, max_rows)
    back = direction == "both"
    group = W.partitionBy(key, PART)
    along = group.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    against = group.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)

    seen = df.select("*", *[F.last(c, ignorenulls=True).over(along).alias(f"_p_{c}") for c in columns])
    if back:
        seen = seen.select("*", *[F.last(c, ignorenulls=True).over(against).alias(f"_n_{c}") for c in columns])
    split = HOT in df.columns
    if split:
        seen = seen.join(_carry(df, key, order, columns, back), [key, PART], "left")
    filled = {}
    for c in columns:
        nearest = ([f"_n_{c}"] if back else []) + ([f"_cn_{c}"] if back and split else [])
        nearest += [f"_p_{c}"] + ([f"_cp_{c}"] if split else [])
        filled[c] = F.coalesce(*nearest).alias(c)
    return seen.select(*[filled.get(c, F.col(c)) for c in df.columns])


def _carry(df, key, order, columns, back):
    """Per part of a hot key: the nearest known value of each column before and after it."""
    at = F.struct(*order)

    def known(c):
        return F.when(F.col(c).isNotNull(), at)

    edges = df.filter(HOT).groupBy(key, PART).agg(
        *[F.max_by(c, known(c)).alias(f"_l_{c}") for c in columns],
        *[F.min_by(c, known(c)).alias(f"_f_{c}") for c in columns if back],
    )
    before = W.partitionBy(key).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(F.col(PART).desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(
        "*", *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_cp_{c}") for c in columns]
    )
    if back:
        carry = carry.select(
            "*", *[F.last(f"_f_{c}", ignorenulls=True).over(after).alias(f"_cn_{c}") for c in columns]
        )
    return materialize(carry.select(key, PART, *[c for c in carry.columns if c.startswith(("_cp_", "_cn_"))]))


def running_totals(df, order, sums=None, position="position"):
    """Whole-table row number and running sums, in the order of the given columns.

    `sums` maps a result name to the summed column. The rows are range-partitioned by the
    order columns themselves, whatever their types, sorted and written once; the totals of
    the partitions, a row for each, pass through a single task. One path for every size.
    Spark's order holds: nulls first, NaN above all numbers.
    """
    sums = dict(sums or {})
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    totals = rows.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_t_{name}") for name in sums],
    )
    upto = W.partitionBy("_range").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_rows") + 1
    return rows.join(offsets, "_range").select(
        *df.columns,
        place.cast("bigint").alias(position),
        *[(F.sum(c).over(upto) + F.col(f"_t_{name}")).alias(name) for name, c in sums.items()],
    )
