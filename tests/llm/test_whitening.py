"""Whitened components against a dense decomposition."""

import numpy as np
import pytest

from wardflow.llm import whitening


def dense(vectors, count):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - sums]
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:count], q[:, ::-1][:, :count]
    return deviation, centred @ q / np.sqrt(values), values / np.trace(cov)


def check(out, keys, vectors, count=8):
    deviation, whitened, explained = dense(vectors, count)
    rows = {}
    for r in out.collect():
        assert r.n == len(vectors) and r.identity_error < 1e-9
        rows.setdefault(r[0], {})[r.component] = r
    assert sorted(rows) == sorted(keys)
    got = np.array([[rows[k][c].whitened for c in sorted(rows[k])] for k in keys])
    assert got.shape == whitened.shape
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-8
    assert [int(rows[k][1].deviation) for k in keys] == deviation
    assert np.allclose([rows[keys[0]][c].explained for c in sorted(rows[keys[0]])], explained, rtol=1e-9)


def test_given_embeddings(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").dropDuplicates(["vec_id"])
    rows = table.orderBy("vec_id").collect()
    check(whitening.whiten(table), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("dims", [1, 3, 12, 90])
def test_spectra(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((400, dims)) * np.linspace(3, 1, dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, component string").repartition(5)
    check(whitening.whiten(frame), list(range(400)), x, min(8, dims))


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(100, None), (101, []), (102, [1.0]), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    check(whitening.whiten(frame), list(range(50)), x, 4)


def test_fewer_directions_than_asked_for(spark):
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [1.0, 2.0, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(frame).collect()
    assert len(out) == 10 and {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-9


def test_exact_beyond_64_bits(spark):
    x = [[1e8, 3.0], [-1e8, 1.0], [5.0, 5.0], [2e8, 4.0]] * 3
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    want = dense(x, 1)[0]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame).collect()}
    assert max(want) > 1 << 62 and got == dict(enumerate(want))


def test_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns[0] == "vec_id"


def test_filter_lifts_the_wanted_part():
    class Diagonal:
        dims = 60
        values = np.r_[np.linspace(10, 9, 8), np.linspace(8.9, 5, 52)]

        def times(self, q):
            return self.values[:, None] * q

    values, q, residuals = whitening.eigenpairs(Diagonal(), 8)
    assert np.allclose(values, Diagonal.values[:8], rtol=1e-13) and residuals.max() <= 1e-12 * 10
    assert np.allclose(np.abs(q), np.eye(60)[:, :8], atol=1e-11)
