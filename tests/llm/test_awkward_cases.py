"""Cases that a review found: ids with several texts, clashing names, other parameters, odd targets."""

import random

import numpy as np
import pytest
from test_documents import SCHEMA, awkward_rows, bag, brute_repeats, words_of

from wardflow.llm import ann, ftrl, hilbert, mixing, pieces, repeats, simhash


def test_an_id_with_two_texts_loses_only_its_own_repeats(spark):
    rng = random.Random(1)
    passage, unique = words_of(rng, 70), words_of(rng, 80)
    rows = [(0, passage + " " + words_of(rng, 5)), (1, words_of(rng, 9) + " " + passage), (1, unique), (1, unique), (2, unique + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for leaves in (1, repeats.LEAVES):
        assert bag(tuple(r) for r in repeats.digests(frame, leaves=leaves).collect()) == bag(brute_repeats(rows))


@pytest.mark.parametrize("window", [8, 12, 300])
def test_other_windows(spark, window):
    rng = random.Random(window)
    base = words_of(rng, 400)
    rows = [(0, base), (1, base), (2, words_of(rng, 20) + " " + " ".join(base.split()[50:370])), (3, words_of(rng, 350))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = bag(brute_repeats(rows, window))
    assert bag(tuple(r) for r in repeats.digests(frame, window=window).collect()) == want


def test_windows_out_of_bounds(spark):
    frame = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    for window in (6, 1 << 15):
        with pytest.raises(ValueError):
            repeats.digests(frame, window=window)


def test_the_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} and more") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    assert ftrl.sample(docs, labels, labels["toxic"], max_rows=5).count() == 5


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_neighbours_of_doubles_that_floats_cannot_tell_apart(spark, size):
    rows = [(i, [size, size + i * size * 1e-9, 2.0]) for i in range(120)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 40 = 0", 3).collect()
    x = np.array([v for _, v in rows])
    for q in (0, 40, 80):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(120), distance)) if i != q][:3]
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[1] for g in got] == order and [g[2] for g in got] == distance[order].tolist()


EXTRA = ["_version", "version", "row", "order", "ids", "round_trip", "shard", "slot", "key", "id", "rate", "copies", "_copy"]


def with_extra(spark):
    rows = [r[:5] + tuple(range(len(EXTRA))) for r in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA))


def test_clashing_names(spark):
    docs = with_extra(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("_version != 0 or slot != 7").isEmpty()
    labels = spark.createDataFrame([(i * 3, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    mixed = mixing.mix_documents(docs, labels)
    assert mixed.columns == docs.columns and mixed.filter("copies != 11").isEmpty()
    out = pieces.encode(docs, "text", "ids", check="round_trip")
    assert out.columns[-2:] == ["ids", "round_trip"] and out.filter("input_ids != 4 or input_round_trip != 5").isEmpty()
    assert set(docs.columns) <= {c.removeprefix("input_") for c in out.columns}


def test_shards_of_documents_that_have_such_columns(spark, tmp_path):
    frame = spark.createDataFrame([(i, "x" * i, "en", "s", 9, 8) for i in range(20)], "doc_id long, text string, lang string, source string, shard int, slot int")
    hilbert.write_shards(frame, hilbert.document_shards(frame, 4), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 20 and back.filter("input_shard != 9 or input_slot != 8").isEmpty()


def test_rows_equal_in_id_and_text_keep_the_same_one(spark):
    rows = [(1, "a b c d", "en", f"s{i}", 7, 1, "k", "l", 1, 2) for i in range(9)]
    kept = {tuple(simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(kept) == 1


def posteriors(spark, p, n):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(4)


def test_targets_are_shares_of_the_stated_total(spark):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.4, 0.4, 0.4], 2000), rng.integers(1, 300, 2000)
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    for total in (0.5, 1.0, 2.0):
        history, targets, reached = mixing.fit_rates(posteriors(spark, p, n), weights, total=total)
        assert targets == pytest.approx(np.array([0.2, 0.5, 0.3]) * total * n.sum())
        assert np.abs(reached - targets).max() <= 1e-3 * targets.sum()
        assert (mixing._rates(p.T, history) < 1).any()


def nearest_totals(p, n, targets, rounds=20_000):
    """Totals of nonnegative rates nearest to the targets: dense projected gradient."""
    a = p * np.sqrt(n)[:, None]
    white = np.eye(3) / np.linalg.eigvalsh(a.T @ a)[-1]
    x = np.sqrt(n).astype(float)
    for _ in range(rounds):
        step = np.maximum(0.0, x - a @ (white @ (a.T @ x - targets)))
        if np.abs(step - x).max() < 1e-10:
            break
        x = step
    return a.T @ x


def test_targets_out_of_reach_end_at_the_nearest_totals(spark):
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.uniform(0.5, 0.9, 400), rng.uniform(0.05, 0.4, 400), np.full(400, 0.001)])
    p, n = p / p.sum(1, keepdims=True), rng.integers(20, 90, 400)
    table = posteriors(spark, p, n)
    history, targets, reached = mixing.fit_rates(table, mixing.WEIGHTS, total=1.0, rounds=120, tolerance=1e-4)
    assert abs(reached[2] - targets[2]) > 0.01 * targets.sum()
    assert np.abs(reached - nearest_totals(p, n, targets)).max() <= 5e-2 * targets.sum()
    assert 0 < len(history) <= 120


def test_reached_totals_are_in_every_row(spark):
    rows = [(i, words_of(random.Random(i), 30)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixed_rates(docs, labels).collect()
    total = sum(r.n_tokens for r in out)
    assert sum(out[0].targets) == pytest.approx(mixing.TOTAL * total)
    reached = np.sum([np.array(r.posterior) * r.rate * r.n_tokens for r in out], axis=0)
    assert all(r.reached == pytest.approx(reached.tolist()) for r in out)
    assert out[0].reached == pytest.approx([sum(out[0].targets) / 3] * 3, rel=1e-3)
