"""Whitened components of an embedding table by Chebyshev-filtered subspace iteration.

Entries c become the integers floor(1024 c) + 100000. Their covariance V is never gathered:
a pass sends a block Q of a few columns to the tasks and adds up Xc' (Xc Q) over the centred
vectors Xc, which is n V Q. The Chebyshev recurrence over such passes (Zhou and Saad,
"Self-consistent-field calculations using Chebyshev-filtered subspace iteration", 2006)
damps what lies between 0 and the smallest Ritz value of the block and lifts the rest; QR
and a Rayleigh-Ritz step follow, until the residuals of the wanted pairs certify them. The
block has four times the wanted columns, because the spectrum of embeddings is flat.

Sums of the integers are exact. What reaches the driver is a block of dims x columns.

Defined results: vectors that are null, or hold a null, an entry that is not finite or one of
2**30 or more, take no part, nor do those of another length than most (of equally frequent
lengths the smallest) or of no length. Repeated rows and null ids are rows of their own.
Components without variance (fewer distinct vectors than dimensions, equal vectors) cannot
be whitened and are left out, so a table of equal vectors, like an empty one, gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm.stages import stored

SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 30)
DEGREE = 12
#: Residual, as a share of the largest eigenvalue, at which a pair is certified; rounding may
#: stop it earlier, at FLOOR at most.
TOLERANCE, FLOOR = 1e-14, 1e-12
ROUNDS = 200
_SCHEMA = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def vectors(table, key="vec_id", vector="embedding"):
    """(id, x) of the rows that take part, and their dimensions; x is packed 64-bit integers."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT))
    rows = rows.filter(F.coalesce(fits & (F.size("x") > 0), F.lit(False)))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = most["d"] if most else 0

    def run(batches):
        for batch in batches:
            c = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dims, 1))
            x = np.floor(SCALE * c).astype("<i8") + SHIFT
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    return stored(rows.filter(F.size("x") == dims).mapInArrow(run, "id long, x binary"), "vectors"), dims


def _integers(batch, dims):
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, dims)


def _summed(table, shape, part_of):
    """Sum over all record batches of part_of(batch), arrays of this shape."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += part_of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "value"])

    sums = table.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(shape)


def exact_sums(table, dims):
    """(n, sums of the dimensions as Python integers)."""

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            sums = _integers(batch, dims).sum(0)  # below 2**62: a batch has some thousand rows
            n, high, low = n + batch.num_rows, high + (sums >> 32), low + (sums & 0xFFFFFFFF)
        columns = [np.arange(dims, dtype=np.int32), np.full(dims, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "n", "high", "low"])

    sums = table.mapInArrow(run, "place int, n long, high long, low long").groupBy("place")
    rows = sums.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("place").collect()
    return (rows[0]["n"] if rows else 0), [(r["high"] << 32) + r["low"] for r in rows]


class Centred:
    """A stored table of vectors with its exact sums; products with the covariance."""

    def __init__(self, table, dims):
        self.table, self.dims = table, dims
        self.n, self.sums = exact_sums(table, dims) if dims else (0, [])
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def rows_of(self):
        """A function that gives the centred rows of a batch, without a tie to the session."""
        base, rest, dims = self.base, self.rest, self.dims
        return lambda batch: (_integers(batch, dims) - base).astype(float) - rest

    def times(self, q):
        """The covariance times q: one pass."""
        rows = self.rows_of()

        def part(batch):
            x = rows(batch)
            return x.T @ (x @ q)

        return _summed(self.table, q.shape, part) / self.n

    def trace(self):
        rows = self.rows_of()
        return float(_summed(self.table, (1,), lambda batch: np.array([(rows(batch) ** 2).sum()]))[0]) / self.n


def _filtered(data, q, first, low, high, top, degree):
    """The Chebyshev polynomial of the covariance times q, scaled to 1 at top; first = V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    scale = sigma
    before, now = q, (first - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / scale - sigma)
        before, now = now, (data.times(now) - middle * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def eigenpairs(data, count, degree=DEGREE, rounds=ROUNDS):
    """(values, vectors, residuals): the largest eigenpairs of the covariance of a Centred."""
    width = min(data.dims, 4 * count)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((data.dims, width)))[0]
    last = np.inf
    for _ in range(rounds):
        product = data.times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        wanted = slice(0, min(count, width))
        residuals = np.linalg.norm(product[:, wanted] - q[:, wanted] * values[wanted], axis=0)
        worst = residuals.max()
        small = worst <= FLOOR * values[0]
        if values[0] <= 0 or worst <= TOLERANCE * values[0] or (small and worst > last / 2):
            return values[wanted], q[:, wanted], residuals
        last = worst
        high = max(values[-1], 1e-3 * values[0])  # all else lies below the smallest Ritz value
        q = np.linalg.qr(_filtered(data, q, product, 0.0, high, values[0], degree))[0]
    raise RuntimeError(f"components are not certified after {rounds} rounds: residual {worst:.3g}")


def _deviations(d, dims):
    """Exact sums of squares of the rows of d, an array of integers."""
    if not len(d) or int(np.abs(d).max()) ** 2 * dims < 1 << 63:
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(int(v) ** 2 for v in row) for row in d], pa.decimal128(38, 0))


def whiten(table, count=8, key="vec_id", vector="embedding"):
    """key, component (from 1), n, deviation, whitened, explained and identity_error for each
    row that takes part and each component up to count."""
    found, dims = vectors(table, key, vector)
    data = Centred(found, dims)
    trace = data.trace() if data.n else 0.0
    if not trace:
        return table.sparkSession.createDataFrame([], _SCHEMA).withColumnRenamed("id", key)
    values, q, _ = eigenpairs(data, count)
    values, q = (a[..., values > 1e-12 * values[0]] for a in (values, q))
    k, turn, rows = len(values), q / np.sqrt(values), data.rows_of()
    means = _summed(found, (k,), lambda batch: (rows(batch) @ turn).sum(0)) / data.n

    def square(batch):
        w = rows(batch) @ turn - means
        return w.T @ w

    error = float(np.abs(_summed(found, (k, k), square) / data.n - np.eye(k)).max())
    n, explained = data.n, values / trace
    wide = n * (1 << 42) >= 1 << 62  # n x may leave 64 bits
    sums = np.array(data.sums, object if wide else np.int64)

    def run(batches):
        for batch in batches:
            m, x = batch.num_rows, _integers(batch, dims)
            deviation = _deviations((x.astype(object) if wide else x) * n - sums, dims)
            at = pa.array(np.repeat(np.arange(m), k))
            arrays = [batch.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n))]
            arrays += [deviation.take(at), pa.array((rows(batch) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.mapInArrow(run, _SCHEMA).withColumnRenamed("id", key)
