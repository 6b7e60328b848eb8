"""Mergeable profiles: the same for every cut into parts, and near the exact profile."""

import pytest
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators import mergeable as G
from wardflow.operators import profile as R
from wardflow.streaming import streams

SCHEMA = "Patient_ID string, x double, k bigint, t string"


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"p{i % 9}", None if i % 11 == 0 else (i % 301 - 150) * 10.0 ** (i % 5 - 2), i, None if i % 7 == 0 else f"t{i % 13}") for i in range(3000)]
    return spark.createDataFrame([*made, ("p1", float("nan"), 5, "é"), ("p2", float("inf"), 6, "")], SCHEMA)


def found(profile, df):
    return {r["column_name"]: r for r in G.statistics(profile, R.recorded_schema(df)).collect()}


@pytest.mark.parametrize("cuts", [1, 7])
def test_merged_parts_equal_the_whole(spark, rows, cuts):
    state = None
    for i in range(cuts):
        part = G.parts(rows.filter(F.col("k") % cuts == i))
        state = part if state is None else G.merged(state.unionByName(part))
    finite = rows.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got, want = found(state, rows), {r["column_name"]: r for r in R.profile_numeric(finite, ["x", "k"]).collect()}
    assert set(got) == {"x", "k"}
    for c in got:
        for s in ("dtype", "min", "max", "null_count", "n_rows"):
            assert got[c][s] == want[c][s]
    assert got["k"]["mean"] == pytest.approx(want["k"]["mean"])
    assert got["k"]["std"] == pytest.approx(want["k"]["std"])
    assert got["k"]["median"] == pytest.approx(want["k"]["median"], rel=2e-3)
    values = {tuple(r) for r in G.values(state).collect()}
    assert values == {tuple(r) for r in R.profile_values(rows, ["Patient_ID", "t"]).collect()}


def test_empty_table_and_column_of_nulls(spark, rows):
    assert G.parts(rows.limit(0)).isEmpty()
    nulls = rows.withColumn("x", F.lit(None).cast("double"))
    got = found(G.parts(nulls), nulls)["x"]
    assert (got["null_count"], got["n_rows"], got["min"], got["median"], got["std"]) == (3002, 3002, None, None, None)


def test_drift_does_not_depend_on_files_per_batch(spark, rows, tmp_path):
    base = rows.filter("k < 500")
    profile = {"schema": R.recorded_schema(base), "statistics": R.profile_numeric(base), "values": R.profile_values(base, ["t"])}
    new = rows.withColumn(S.KEY, F.when(F.col("k") % 100 > 0, F.col(S.KEY)))
    new.repartition(7, "k").write.parquet(f"{tmp_path}/landing")
    results = []
    for files in (1, 3, 1000):
        out = f"{tmp_path}/out-{files}"
        stream = streams.file_stream(spark, f"{tmp_path}/landing", new.schema, "parquet", files_per_batch=files)
        streams.drift_stream(stream, profile, out, f"{out}/checkpoint")
        results.append(sorted(map(str, streams.drift_so_far(spark, out).collect())))
        assert len(streams.batch_numbers(spark, f"{out}/state")) == {1: 7, 3: 3, 1000: 1}[files]
    assert results[0] == results[1] == results[2]
    assert any("null_key" in r for r in results[0]) and any("max" in r for r in results[0])
