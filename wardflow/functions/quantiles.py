"""Exact interpolated quantiles by narrowing brackets, without ordering the rows."""

import math

from pyspark.sql import functions as F


class _Search:
    """One column and share: the wanted ranks and the open bracket (low, high) that holds those
    that are not known yet. `base` rows are at low or below, `inside` lie in the bracket."""

    def __init__(self, column, share, n):
        at = share * (n - 1)
        self.column, self.share, self.weight = column, share, at - math.floor(at)
        self.ranks, self.known = {math.floor(at), math.ceil(at)} if n else set(), {}
        self.ends = (math.floor(at), math.ceil(at))
        self.low = self.high = None
        self.base, self.inside = 0, n

    def open_ranks(self):
        return sorted(self.ranks - set(self.known))

    def value(self):
        if not self.ranks:
            return None
        low, high = (self.known[r] for r in self.ends)
        return low if self.weight == 0 or low == high else low + (high - low) * self.weight


def _tall(df, columns):
    """(i, v): the values of the columns, one row for each, numbered by i.

    A few aggregates by i are compiled code; some for each of many columns, in one row, are interpreted.
    """
    return df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("i", "v"))


def _bracketed(df, searches, borders, few=()):
    """_tall for each search, with its bracket a, b, whether v lies in it, and whether that is few."""

    def each(values, kind):
        return F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("i"))

    rows = _tall(df, [s.column for s in searches])
    a, b = (each([ends[k] for ends in borders], "double") for k in (0, 1))
    rows = rows.withColumns({"a": a, "b": b, "few": each(few or [False] * len(searches), "boolean")})
    return rows.withColumn("m", F.expr("v IS NOT NULL AND (a IS NULL OR v > a) AND (b IS NULL OR v < b)"))


def _narrow(df, searches, accuracy):
    """One scan: a new bracket for each search, from a sketch of the values in the old one.

    A sketch of this accuracy misses a rank by inside / accuracy at most, so the new
    bracket holds the ranks, and 10 / accuracy of the rows at most lie strictly in it.
    """
    margin, shares = 4.0 / accuracy, []
    for s in searches:
        ranks = s.open_ranks()
        shares += [max((ranks[0] - s.base) / s.inside - margin, 0.0), min((ranks[-1] - s.base + 1) / s.inside + margin, 1.0)]
    rows = _bracketed(df, searches, [(s.low, s.high) for s in searches]).filter("m")
    sketch = F.expr(f"percentile_approx(v, array({', '.join(f'{x!r}D' for x in shares)}), {accuracy})")
    own = [F.get("ends", F.col("i") * 2 + k).alias(f"e{k}") for k in (0, 1)]
    found = {r["i"]: (r["e0"], r["e1"]) for r in rows.groupBy("i").agg(sketch.alias("ends")).select("i", *own).collect()}
    return [found[i] for i in range(len(searches))]


def _settle(df, searches, borders, accuracy):
    """One scan: counts around the new brackets; their values too where those are few."""
    few = [10 * s.inside <= accuracy * accuracy for s in searches]
    counts = {"l": "v < a", "a": "v = a", "m": "m", "b": "v = b"}
    wanted = [F.expr(f"count_if({test})").alias(f"n_{k}") for k, test in counts.items()]
    wanted.append(F.expr("sort_array(collect_list(CASE WHEN m AND few THEN v END))").alias("values"))
    found = {r["i"]: r for r in _bracketed(df, searches, borders, few).groupBy("i").agg(*wanted).collect()}
    for i, (s, (low, high)) in enumerate(zip(searches, borders)):
        below, at_low, middle, at_high = (found[i][f"n_{k}"] for k in "lamb")
        at_high = 0 if low == high else at_high
        for rank in s.open_ranks():
            if rank < below or rank >= below + at_low + middle + at_high:
                raise ValueError("quantile bracket missed its rank; use a higher accuracy")
            if rank < below + at_low:
                s.known[rank] = low
            elif rank >= below + at_low + middle:
                s.known[rank] = high
            elif few[i]:
                s.known[rank] = found[i]["values"][rank - below - at_low]
        s.low, s.high, s.base, s.inside = low, high, below + at_low, middle


def exact_quantiles(df, columns, shares=(0.5,), accuracy=10_000, stats=None):
    """Rows (column_name, share, value) with linear interpolation between neighbours.

    Runs when called, in scans that handle all columns and shares at once. A mergeable
    sketch brackets the wanted ranks; a second scan counts what is below the bracket and,
    once it holds `accuracy` values at most, fetches them. That is two scans up to
    accuracy ** 2 / 10 rows; above, sketch and count are repeated inside the bracket. No
    scan holds more than `accuracy` values of a column and share. `stats` maps further
    result columns to SQL aggregates of {c} with their type, which the first scan computes.
    """
    spark, stats = df.sparkSession, stats or {}
    margin = 4.0 / accuracy
    ends = ", ".join(f"{p!r}D" for q in shares for p in (max(q - margin, 0.0), min(q + margin, 1.0)))

    def measures(c):
        fields = {"n": "count({c})", "ends": f"percentile_approx(cast({{c}} AS double), array({ends}), {accuracy})"}
        fields.update({s: f"cast({aggregate} AS {kind})" for s, (aggregate, kind) in stats.items()})
        body = ", ".join(f"'{s}', {sql}" for s, sql in fields.items())
        return F.expr(f"named_struct({body})".format(c=c))

    # an average of decimals is one of decimals, so these columns are not made doubles before it
    decimals = [c for c, kind in df.dtypes if c in columns and kind.startswith("decimal")]
    tall, first = [c for c in columns if c not in decimals], {}
    if decimals:
        first.update(df.agg(*[measures(f"`{c}`").alias(c) for c in decimals]).first().asDict())
    if tall:
        rows = _tall(df, tall).groupBy("i").agg(measures("v").alias("m")).collect()
        first.update({tall[r["i"]]: r["m"] for r in rows})
    if len(first) < len(columns):  # a table without rows
        none = spark.range(0).select(F.lit(None).cast("double").alias("v")).agg(measures("v").alias("m")).first()["m"]
        first = {c: first.get(c, none) for c in columns}
    found = [_Search(c, q, first[c]["n"]) for c in columns for q in shares]
    left = [s for s in found if s.open_ranks()]
    borders = {}
    for s in left:
        at = 2 * list(shares).index(s.share)
        # few rows need no bracket, and their ranks lie too far apart for the margin
        borders[id(s)] = (None, None) if s.inside <= accuracy else tuple(first[s.column]["ends"][at : at + 2])
    while left:
        _settle(df, left, [borders[id(s)] for s in left], accuracy)
        left = [s for s in left if s.open_ranks()]
        if left:
            borders = dict(zip(map(id, left), _narrow(df, left, accuracy)))
    fields = ["column_name string", "share double", "value double", *[f"{s} {kind}" for s, (_, kind) in stats.items()]]
    rows = [(s.column, s.share, s.value(), *[first[s.column][x] for x in stats]) for s in found]
    return spark.createDataFrame(rows, ", ".join(fields))
