"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from wardflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, list int"


def brute(rows, k, asked):
    dims = {}
    good = []
    for r in rows:
        i, v = r[0], r[1]
        if i is None or v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        good.append((i, np.array(v, np.float32).astype(float)))
        dims[len(v)] = dims.get(len(v), 0) + 1
    most = min(dims, key=lambda d: (-dims[d], d))
    good = [g for g in good if len(g[1]) == most]
    out = {}
    for q in {i for i, _ in good if asked(i)}:
        near = {}
        for own in (v for i, v in good if i == q):
            for i, v in good:
                if i != q:
                    near[i] = min(near.get(i, np.inf), float(np.sqrt(((own - v) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def found(frame, k, **options):
    out = {}
    for r in ann.search(frame, "id % 10 = 0", k, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(s, i) for _, s, i in rows] for q, rows in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 24))
    x = (centers[rng.integers(0, 6, 600)] + 0.6 * rng.normal(size=(600, 24))).astype(np.float32)
    x[50:120] = x[50]  # many equal vectors
    out = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1010, []), (1020, [0.0] * 24), (1030, [1.0] * 23 + [None]), (1040, [float("nan")] * 24)]
    bad += [(1050, [float("inf")] + [1.0] * 23), (1060, [1.0, 2.0]), (None, out[0][1]), out[60], (20, out[3][1])]
    return [(*r, 1, 5, "x", 2) for r in out + bad]


@pytest.mark.parametrize("chunk,queries", [(4096, 1024), (40, 7)])
def test_all_lists_give_the_exact_answer(spark, rows, monkeypatch, chunk, queries):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "QUERIES", queries)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = found(frame, 10, lists=8, probes=8), brute(rows, 10, lambda i: i % 10 == 0)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert all(any(i == j and s == pytest.approx(t, abs=1e-12) for t, j in want[q]) for s, i in got[q] if i in {j for _, j in want[q]})
    assert got[60] == [(0.0, i) for i in range(50, 61) if i != 60]  # ties go to the smaller ids


def test_recall(spark, folder):
    frame = spark.read.parquet(f"{folder}/../sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in frame.select("vec_id", "embedding").collect()]
    got, want = found(frame, 10), brute(rows, 10, lambda i: i % 10 == 0)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_rows(spark):
    few = [(i, [float(i), 1.0], 0, 0, "", 0) for i in range(0, 60, 10)]
    got = found(spark.createDataFrame(few, SCHEMA), 10)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 6
    assert found(spark.createDataFrame(few[:1], SCHEMA), 10) == {}
    assert found(spark.createDataFrame([], SCHEMA), 10) == {}
