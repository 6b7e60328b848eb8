"""The pipeline's stages on a small folder, each against brute force on its own input."""

import random

import pytest
from test_documents import brute_lines, brute_print, classes_of, split, words_of

import corpus_pipeline
from wardflow.llm import mixing, pieces, quality
from wardflow.llm.stages import stored


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("corpus"))
    base = [words_of(rng, 120) for _ in range(30)]
    texts = base + base[:5] + [t + " tail end" for t in base[5:9]] + ["few words", "", None]
    texts += [base[10][:200] + "\n" + words_of(rng, 90) for _ in range(3)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 3 > 0, i % 7 == 0) for i in range(40)]
    labels = [(i, int(a), int(b)) for i, a, b in labels]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder_of):
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        after = stored(stage(spark, docs, folder_of))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    out = docs.collect()

    verdicts = {r.doc_id: r.kept for r in quality.document_verdicts(spark.read.parquet(f"{folder_of}/documents.parquet")).collect()}
    assert {r[0] for r in inputs[1]} == {k for k, v in verdicts.items() if v}
    assert all(len(split(r[1])) >= 50 for r in inputs[1])

    gone = {(d, p) for d, p, kept in brute_lines([r[:2] for r in inputs[1]]) if not kept}
    want = {}
    for doc, text, *_ in inputs[1]:
        cut = [x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone]
        if any(x.strip() for x in cut):
            want[doc] = "\n".join(cut)
    assert {r[0]: r[1] for r in inputs[2]} == want
    assert all(r[4] == len(r[1]) for r in inputs[2])

    roots = classes_of([brute_print(r[1]) for r in inputs[2]], lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, c in zip(inputs[2], roots):
        least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(r[0] for r in inputs[3]) == sorted(least.values())

    frame = spark.createDataFrame(inputs[3], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mixed_rates(frame, spark.read.parquet(f"{folder_of}/labels.parquet")).collect()}
    counts = {}
    for r in inputs[4]:
        counts[r[0]] = counts.get(r[0], 0) + 1
    assert counts == {k: v for k, v in copies.items() if v}

    table = pieces.Pieces(pieces.default_model())
    assert len(out) == len(inputs[4])
    assert all(r.round_trip and table.decode(r.ids) == r.text for r in out)


def test_run_gives_the_last_stage(spark, folder_of):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, folder_of).columns[-2:] == ["ids", "round_trip"]
