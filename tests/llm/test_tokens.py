"""Byte-pair encoding, alignment and token files against the libraries, text by text."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from test_documents import SCHEMA, awkward_rows, bag
from tokenizers import Tokenizer

from wardflow.llm import alignment, bytepairs, chunks, tokenfiles
from wardflow.llm.blocks import numbers, squeezed

PARTS = [" ", "  ", "\n", "\t", " ", "　", " ", "a", "the", "'s", "é", "日本", "1", "23", "!?", "\x1c", "\x85", "🙂", "'", "—", "▁", "<|endoftext|>", "<s>", "\x00", "ﬁ"]


def odd_texts(n=1200):
    rng = random.Random(1)
    return [None, "", " ", "  ", "\n", "x" * 9000, " x", "▁a", "a b " * 3000] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a b", 1, "x"), (0, "again the same", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, key string").repartition(3).cache()


def sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def library():
    ranks = bytepairs.ranks_of(bytepairs.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_the_library(table, texts):
    own = library()
    want = []
    for key, text in [*enumerate(texts), (None, "a b"), (0, "again the same")]:
        ids = own.encode_ordinary(text or "")
        want.append((key, len(ids), sha(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    assert bag(tuple(r) for r in bytepairs.digests(table).collect()) == bag(want)


def test_byte_pairs_in_small_blocks(spark, texts):
    own = library()
    frame = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string").repartition(2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bytepairs.encode(frame, size=64).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts[:300])}
    back = bytepairs.decode(bytepairs.encode(frame)).collect()
    assert {r.doc_id: r.decoded.decode() for r in back} == {i: t or "" for i, t in enumerate(texts[:300])}


def test_byte_pairs_with_many_buckets_and_few_known_words(spark, texts, monkeypatch):
    own, want = library(), {}
    monkeypatch.setattr(bytepairs, "KNOWN", 5)
    frame = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string").repartition(2).cache()
    for i, t in enumerate(texts[:300]):
        want[i] = own.encode_ordinary(t or "")
    for buckets, size in ((1, 1 << 20), (500, 64), (500, 1 << 20)):
        got = bytepairs.encode(frame, size=size, buckets=buckets).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want


def test_blocks_with_other_answers_are_refused():
    words = [b"x"]
    row = {"keys": [1], "counts": [1], "codes": squeezed(np.array([0])), "buckets": squeezed(np.array([3])), "words": words}
    good = pa.table({"code": [3], "sizes": [squeezed(np.array([2]))], "ids": [squeezed(np.array([7, 9]))]})
    assert np.frombuffer(bytepairs._build(row, good).column("ids")[0].as_py(), "<u4").tolist() == [7, 9]
    for other in (good.set_column(0, "code", pa.array([2])), good.set_column(1, "sizes", pa.array([squeezed(np.array([1, 1]))])), good.slice(0, 0)):
        with pytest.raises(RuntimeError):
            bytepairs._build(row, other)


def test_decoding_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, bytearray(), "y")], "doc_id long, ids binary, decoded string")
    assert [(r.doc_id, r.decoded) for r in bytepairs.decode(rows).orderBy("doc_id").collect()] == [(1, None), (2, b"")]


def brute_alignment(texts):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    code = {chr(b): b for b in shown}
    code.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    out, held, docs = [], [], Counter()
    for text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        a_bytes = [bytes(code[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((0, 0, 0, 0, ""))
            held.append({})
            continue
        a_cuts, b_cuts = (np.cumsum([len(t) for t in side]).tolist() for side in (a_bytes, b_bytes))
        cuts = sorted(set(a_cuts) & set(b_cuts))
        groups = [([i for i, e in zip(a, a_cuts) if lo < e <= hi], [i for i, e in zip(b, b_cuts) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 500 else []
        if not groups:
            i = j = 0
            for hi in cuts:
                x, y = [], []
                while i < len(a) and a_cuts[i] <= hi:
                    x.append(a[i])
                    i += 1
                while j < len(b) and b_cuts[j] <= hi:
                    y.append(b[j])
                    j += 1
                groups.append((x, y))
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        docs.update(links.keys())
        held.append(links)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(line.encode()).hexdigest()))
    best = Counter()
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    most = [sum(n for pair, n in links.items() if docs[pair] == best[pair[0]]) for links in held]
    total = [sum(n * docs[pair] for pair, n in links.items()) for links in held]
    return [(*o[:4], m, t, o[4]) for o, m, t in zip(out, most, total)]


@pytest.mark.parametrize("size", [256, alignment.BLOCK])
def test_alignment(table, texts, size):
    keys = [*range(len(texts)), None, 0]
    want = [(k, *row) for k, row in zip(keys, brute_alignment([*texts, "a b", "again the same"]))]
    got = alignment.align(table, size=size)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert bag(tuple(r) for r in got.collect()) == bag(want)


def test_large_groups_lose_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE", 1)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 50)
    a_group, b_group = np.sort(np.r_[np.arange(9), rng.integers(0, 9, 51)]), np.sort(np.r_[np.arange(9), rng.integers(0, 9, 41)])
    want = Counter((g, x, y) for g, x in zip(a_group, a) for h, y in zip(b_group, b) if g == h)
    for large in (1, 10**9):
        monkeypatch.setattr(alignment, "LARGE", large)
        got = Counter()
        for g, x, y, n in zip(*alignment._links(a, b, a_group, b_group, 9)):
            got[g, x, y] += n
        assert got == want


def test_pointers_stop_at_common_borders():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 200)
        sides = [np.append(np.flatnonzero(rng.random(n) < share), n) for share in rng.random(2)]
        common = np.intersect1d(*sides)
        for ends, found in zip(sides, alignment.groups(*sides)):
            assert found.tolist() == np.searchsorted(common, ends).tolist()


def test_token_files_of_odd_texts(table, texts):
    tokenizer = Tokenizer.from_file(tokenfiles.default_tokenizer())
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_table(table).collect()}
    for key, text in [*enumerate(texts), (0, "again the same")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got


def test_chunks_give_the_texts_back(texts):
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    starts = chunks.chunk_starts(data, offsets)
    of, found = chunks.distinct(data, starts)
    reps = found.bytes()
    assert b"".join(reps[i] for i in of) == data.tobytes() and len(set(reps)) == len(reps)
    assert set(offsets[:-1][np.diff(offsets) > 0]) <= set(starts)


def test_squeezed_numbers():
    for n in ([], [0], [65535], [65536, 1], list(range(1000))):
        assert numbers(squeezed(np.array(n, np.int64))).tolist() == n


def test_awkward_documents(spark):
    rows = awkward_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    own = library()
    got = bytepairs.digests(frame).collect()
    assert bag((r.doc_id, r.ids_sha256) for r in got) == bag((r[0], sha(own.encode_ordinary(r[1] or ""))) for r in rows)
    assert alignment.align(frame).count() == len(rows)


@pytest.mark.parametrize("run", [bytepairs.digests, alignment.align])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
