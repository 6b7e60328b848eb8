"""Splits, samples, folds and cohorts: exact sizes, whole groups, same result on every layout."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators import cohorts as C
from wardflow.operators import sampling as G


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(1200):
        patient = "p0" if i % 3 == 0 else f"p{rng.randrange(1, 60)}"
        data.append((i, patient, int(rng.random() < 0.1)))
    return spark.createDataFrame(data, "id bigint, Patient_ID string, SepsisLabel bigint"), data


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_hash_rank(rows, digits):
    df, data = rows
    got = {r["id"]: r["position"] for r in G.hash_rank(df, "id", "s", "SepsisLabel", digits).collect()}
    for label in (0, 1):
        ordered = sorted((r[0] for r in data if r[2] == label), key=lambda i: md5("s", i))
        assert [got[i] for i in ordered] == list(range(1, len(ordered) + 1))


def test_hash_rank_keeps_null_classes(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id bigint, c string")
    got = {r["id"]: (r["position"], r["n"]) for r in G.hash_rank(df, "id", "s", "c", total="n").collect()}
    assert sorted(got.values()) == [(1, 1), (1, 2), (2, 2)]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
@pytest.mark.parametrize("share", [0.0, 0.001, 0.25, 0.5, 1.0])
def test_cuts_equal_order_and_limit(rows, digits, share):
    df, data = rows
    cuts = G.hash_cuts(df, "id", "s", G.share_of_total(share), digits=digits)
    got = {r["id"] for r in df.filter(G.in_sample(cuts, "id", "s")).collect()}
    n = -(-int(1200 * share * 1000) // 1000)
    assert got == set(sorted((r[0] for r in data), key=lambda i: md5("s", i))[:n])


@pytest.mark.parametrize("parts", [1, 16])
def test_group_split(rows, parts):
    df, data = rows
    got = G.group_split(df.repartition(parts)).collect()
    sides = {}
    for r in got:
        sides.setdefault(r["Patient_ID"], set()).add(r["side"])
    assert len(got) == len(data) and all(len(s) == 1 for s in sides.values())
    patients = sorted({r[1] for r in data}, key=lambda p: md5("split", p))
    n = -(-len(patients) // 4)
    assert {p for p, s in sides.items() if s == {"test"}} == set(patients[:n])


def test_undersample(rows):
    df, data = rows
    counts = {r[0]: r[1] for r in G.undersample(df, "id").groupBy("SepsisLabel").count().collect()}
    positives = sum(r[2] for r in data)
    assert counts == {1: positives, 0: 2 * positives}


def test_undersample_fails_without_enough_negatives(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id bigint, SepsisLabel bigint")
    with pytest.raises(Exception, match="fewer negatives"):
        G.undersample(df, "id").collect()


def test_undersample_without_positives(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, SepsisLabel bigint")
    assert G.undersample(df, "id").count() == 0


@pytest.mark.parametrize("draws", [0, 1, 7, 100, 1200])
def test_stratified(rows, draws):
    df, data = rows
    counts = {r[0]: r[1] for r in G.stratified_sample(df, "id", draws).groupBy("SepsisLabel").count().collect()}
    assert sum(counts.values()) == draws
    positives = sum(r[2] for r in data)
    assert abs(counts.get(1, 0) - draws * positives / 1200) < 1


def test_folds(rows):
    df, _ = rows
    sizes = G.assign_folds(df, "id").groupBy("SepsisLabel", "fold").count().collect()
    for label in (0, 1):
        found = [r["count"] for r in sizes if r["SepsisLabel"] == label]
        assert len(found) == 5 and max(found) - min(found) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_equal_parts(spark, n):
    got = G.equal_parts(spark.range(n), "id").groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in got] == [n // 3 + (i < n % 3) for i in range(3) if n // 3 + (i < n % 3)]


def walk(counts):
    """The cohorts by walking over the patients one by one."""
    ordered = sorted(counts, key=lambda c: (-c[1], md5("order", c[0])))
    total, cohort, running, out = sum(c[1] for c in counts), 1, 0, {}
    for patient, positives in ordered:
        out[patient] = cohort
        running += positives
        if cohort < 3 and running >= total * (0.7, 0.2)[cohort - 1]:
            cohort, running = cohort + 1, 0
    return out


@pytest.mark.parametrize("seed", range(12))
def test_cohorts_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([0, 1, 2, 5, 50])
    data = [(f"p{i}", rng.randrange(top + 1) if rng.random() < 0.6 else 0) for i in range(rng.choice([1, 2, 3, 10, 40]))]
    if seed == 11:
        data = [("p0", 100), ("p1", 1), ("p2", 0), ("p3", 0)]
    df = spark.createDataFrame([(p, 5, n) for p, n in data], "Patient_ID string, count_of_0 bigint, count_of_1 bigint")
    got = {r["Patient_ID"]: r["cohort"] for r in C.threshold_cohorts(df).collect()}
    assert got == walk(data)


def test_count_tables_agree(rows):
    df, _ = rows
    a, b = C.label_counts(df), C.label_counts_joined(df)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_quotas(rows):
    df, data = rows
    got = {r["Patient_ID"]: r["d"] for r in C.quota_names(df, "Patient_ID", [("a", 10), ("b", 5)], "rest", "d").collect()}
    ordered = sorted({r[1] for r in data})
    assert [got[p] for p in ordered] == ["a"] * 10 + ["b"] * 5 + ["rest"] * (len(ordered) - 15)


def test_chunks(spark):
    got = C.chunks(spark.range(1201), ["id"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 500), (1, 500), (2, 201)]


def test_strata_of_four_classes(spark):
    df = spark.range(400).withColumn("c", (F.col("id") % 4).cast("int"))
    got = G.stratified_sample(df, "id", 40, by="c").groupBy("c").count().collect()
    assert sorted(map(tuple, got)) == [(c, 10) for c in range(4)]


def test_keys_of_several_columns_are_told_apart(spark):
    rows = [("p", "1|2"), ("p|1", "2"), ("p", None), ("p", ""), (None, "p"), ("", "p"), ("1:p", "-"), ("-", "1:p")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(G.hash_of(["a", "b"], "s")).distinct().count() == len(rows)
    for i in range(0, len(rows), 2):
        pair = spark.createDataFrame(rows[i : i + 2], "a string, b string")
        assert G.row_split(pair, ["a", "b"], 0.5).filter("side = 'test'").count() == 1


@pytest.mark.parametrize("bucket", [1, 3, 1_000_000])
def test_cuts_by_longer_prefixes(spark, bucket):
    df = spark.range(500)
    hashes = sorted(r[0] for r in df.select(G.hash_of("id", "s")).collect())
    for share in (0.002, 0.3, 1.0):
        cuts = G.hash_cuts(df, "id", "s", G.share_of_total(share), digits=1, bucket=bucket)
        assert cuts == {0: hashes[math.ceil(500 * share) - 1]}


def test_strata_of_very_many_classes(spark):
    df = spark.range(30_000).withColumn("c", F.col("id") % 10_000)
    got = G.stratified_sample(df, "id", 10_000, by="c")
    assert got.count() == 10_000 and got.select("c").distinct().count() == 10_000
    few = G.stratified_sample(df, "id", 20, by="c", classes=[1, 2, 3])
    assert few.count() == 9
