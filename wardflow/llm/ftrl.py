"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours and pairs with one word between,
lower-cased in ASCII, without ASCII punctuation, hashed to 2**bits columns. Learning goes
row by row with a rate for every coordinate (McMahan et al., "Ad Click Prediction", 2013);
the L1 term leaves most weights at exactly zero. The rows come from a sample of the
labelled table whose size is a parameter, so one task can hold them; weights are at most
2**bits numbers, which bounds what is broadcast.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm.stages import stored
from wardflow.llm.words import LOWER, PUNCTUATION, mix, slices, text_buffer, words

BITS = 20
MAX_ROWS = 20_000
_KINDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def hashed(part, bits=BITS, text="text"):
    """(row, column) of every feature occurrence of a record batch, and words of each row."""
    data, offsets = text_buffer(part.column(text))
    _, _, h, first = words(data, offsets, borders_at=PUNCTUATION, fold=LOWER)
    rows = np.repeat(np.arange(part.num_rows), np.diff(first))
    found = [(rows, h ^ _KINDS[0])]
    for kind, gap in ((1, 1), (2, 2)):
        same = rows[:-gap] == rows[gap:] if len(h) > gap else np.zeros(0, bool)
        a, b = h[: len(h) - gap][: len(same)], h[gap:][: len(same)]
        found.append((rows[: len(same)][same], (a[same] * _LEFT + b[same]) ^ _KINDS[kind]))
    rows = np.concatenate([r for r, _ in found])
    columns = mix(np.concatenate([c for _, c in found])) >> np.uint64(64 - bits)
    return rows, columns.astype(np.int64), np.diff(first)


def sample(docs, labels, target, key="doc_id", text="text", max_rows=MAX_ROWS, bits=BITS):
    """Stored rows (place, label, columns) of at most max_rows labelled documents, those whose
    hashed keys come first, and of rows with one key those whose features do. target: a column of labels, not null where it is to be used."""
    chosen = labels.select(F.col(key).alias("_key"), target.alias("label")).filter("_key is not null and label is not null")
    chosen = chosen.groupBy("_key").agg(F.max("label").alias("label"))
    chosen = stored(chosen.orderBy(F.xxhash64("_key"), "_key").limit(max_rows), "sample")  # max_rows bounds the broadcast
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    rows = rows.select(F.xxhash64("_key").alias("place"), F.col("label").cast("int").alias("label"), "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, column, _ = hashed(part, bits)
                pairs = np.unique(row << bits | column)
                cuts = np.searchsorted(pairs >> bits, np.arange(part.num_rows + 1))
                columns = (pairs & ((1 << bits) - 1)).astype("<u4")
                packed = [columns[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                arrays = [part.column("place"), part.column("label"), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["place", "label", "columns"])

    features = stored(rows.mapInArrow(run, "place long, label int, columns binary"), "features")
    if features.count() > max_rows:  # ids that repeat
        features = stored(features.orderBy("place", "label", "columns").limit(max_rows), "features")
    return features


def learn(rows, labels, bits=BITS, rounds=4, alpha=1.5, beta=1.0, l1=5.0, l2=0.1):
    """Weights of 2**bits columns and a bias (last) for 0/1 labels of rows of column numbers."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for row, label in zip(rows, labels):
            at = np.append(row, size - 1).astype(np.int64)
            w = weights(at)
            w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)  # the bias is not shrunk
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    out = weights(np.arange(size))
    out[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
    return out


def fit(features, classes=(1,), bits=BITS, **options):
    """Weights of one classifier for each class against the rest: an array (classes, 2**bits + 1).

    Learns in one task on the bounded sample, in the order of hashed keys; only weights
    other than zero come back.
    """

    def run(batches):
        rows, labels = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            rows += [np.frombuffer(c.as_py(), "<u4") for c in batch.column("columns")]
        for i, c in enumerate(classes):
            w = learn(rows, [float(x == c) for x in labels], bits, **options)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(w[at])], names=["i", "at", "w"])

    ordered = features.repartition(1).sortWithinPartitions("place", "label", "columns")
    found = ordered.mapInArrow(run, "i long, at long, w double").toArrow()
    out = np.zeros((len(classes), (1 << bits) + 1))
    out[found.column("i").to_numpy(), found.column("at").to_numpy()] = found.column("w").to_numpy()
    return out


def scores(part, weights, bits=BITS, text="text"):
    """(probabilities, words): one row of probabilities for each classifier."""
    row, column, lengths = hashed(part, bits, text)
    used = np.flatnonzero((weights[:, column] != 0).any(axis=0)) if len(column) else np.zeros(0, np.int64)
    pairs = np.unique(row[used] << bits | column[used])
    row, column = pairs >> bits, pairs & ((1 << bits) - 1)
    sums = [np.bincount(row, w[column], part.num_rows) + w[-1] for w in weights]
    return 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35))), lengths
