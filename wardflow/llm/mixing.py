"""Mixing to target weights with soft membership.

A classifier learned from a labelled table (one FTRL classifier for each domain, their
probabilities divided by their sum) gives every document posteriors p_k over domains. With
n tokens and rate r >= 0 a document is expected to bring r n p_k tokens to domain k. Rates
come from least squares: expected domain totals against targets, by projected gradient over
all documents at once.

The variables are sqrt(n) r, and residuals are whitened by the matrix H = sum n p p' of the
corpus (K by K), so a step of 1 is safe; where that does not reach the targets, the rounds
begin again with plain residuals and a step of 1 over the largest eigenvalue of H. Then the gradient of a document is p . g with one
vector g a round, and its rate is a function of p and the g of the rounds so far: rates need
no table between rounds, and each round is one aggregate of K sums. That history, some
dozens of K numbers, is all that reaches the driver.

The targets are the weights' shares of a stated total of tokens. They may be out of reach for
the posteriors at hand: rates cannot be negative, and posteriors that are alike in all
documents fix the shares. The rounds then end at the nearest totals there are, and every row
carries the targets and the totals reached, by domain.

Defined results: a null or empty text has no tokens, so it does not bear on the targets; its
rate follows from the posteriors of the biases. Repeated rows are documents of their own.
Without labelled rows all posteriors are equal; an empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import ftrl
from wardflow.llm.stages import stored
from wardflow.llm.words import slices

#: Domains of the labels table and the share of the expected tokens each shall have.
WEIGHTS = {"good": 0.88, "poor": 0.09, "toxic": 0.03}
#: Tokens of the mixed corpus, as a multiple of those of the documents.
TOTAL = 1.05
ROUNDS, TOLERANCE = 60, 1e-4


def domain_of_labels():
    """Number of the domain of a row of labels, in the order of WEIGHTS; null if unknown."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def fit_domains(docs, labels, target, n_domains, key="doc_id", text="text", max_rows=ftrl.MAX_ROWS, bits=ftrl.BITS):
    """Classifier weights from at most max_rows labelled rows."""
    features = ftrl.sample(docs, labels, target, key, text, max_rows, bits)
    return ftrl.fit(features, tuple(range(n_domains)), bits)


def _posteriors(part, weights, bits, text="text"):
    found, lengths = ftrl.scores(part, weights, bits, text)
    return found / found.sum(axis=0), lengths


def _rates(p, history):
    """Rates after the rounds of history, for posteriors p (domains, documents)."""
    r = np.ones(p.shape[1])
    for g in history:
        r = np.maximum(0.0, r - g @ p)
    return r


def posteriors(docs, weights, bits=ftrl.BITS, text="text"):
    """(n_tokens, p) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p, lengths = _posteriors(part, shared.value, bits)
                arrays = [pa.array(lengths.astype(np.int64)), pa.array(list(p.T), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["n_tokens", "p"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long, p array<double>")


def _totals(table, history, k):
    """Expected tokens of each domain at the rates of history, and sum r n p p'."""

    def run(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            n = batch.column("n_tokens").to_numpy().astype(float)
            p = np.array(batch.column("p").flatten().to_numpy()).reshape(-1, k).T
            weight = n * _rates(p, history)
            total += p @ weight
            square += (p * n) @ p.T
        row = [pa.array([total.tolist()]), pa.array([square.ravel().tolist()])]
        yield pa.RecordBatch.from_arrays(row, names=["t", "h"])

    sums = table.mapInArrow(run, "t array<double>, h array<double>")
    row = sums.agg(*[F.sum(F.col("t")[i]) for i in range(k)], *[F.sum(F.col("h")[i]) for i in range(k * k)]).first()
    values = np.array([x or 0.0 for x in row])
    return values[:k], values[k:].reshape(k, k)


def targets_of(weights, shrinking, natural, growth=1.03):
    """Target tokens: shares of the smallest total at which all but shrinking domains grow."""
    shares = np.array(list(weights.values())) / sum(weights.values())
    keeps = [i for i, name in enumerate(weights) if name not in shrinking]
    return shares * growth * max((natural[i] / shares[i] for i in keeps if shares[i] > 0), default=0.0)


def fit_rates(table, weights=WEIGHTS, shrinking=None, rounds=ROUNDS, tolerance=TOLERANCE, total=TOTAL):
    """(history, targets, reached): the rounds of projected gradient on a stored table of
    posteriors.

    The targets are shares of total times the tokens there are; with shrinking, domains that
    may lose tokens, shares of the smallest total at which the others grow. Stops when all
    domains are within the tolerance, as a share of all tokens, or when a round of the
    projected gradient moves none of them by a tenth of it any more.
    """
    k, history = len(weights), []
    now, square = _totals(table, history, k)
    shares = np.array(list(weights.values())) / sum(weights.values())
    targets = shares * total * now.sum() if shrinking is None else targets_of(weights, shrinking, now)
    white, unit = np.linalg.pinv(square, rcond=1e-9, hermitian=True), max(targets.sum(), 1.0)
    plain = np.eye(k) / max(np.linalg.eigvalsh(square)[-1], 1e-300)
    for step in (white, plain):
        # where the targets are out of reach, the nearest totals are those of plain least squares
        history, moved = [], np.inf
        for _ in range(rounds):
            gap = now - targets
            if np.abs(gap).max() <= tolerance * unit:
                return history, targets, now
            if moved <= 0.1 * tolerance * unit:
                break
            history.append(step @ gap)
            before, (now, _) = now, _totals(table, history, k)
            moved = np.abs(now - before).max()
        if step is white:
            now, _ = _totals(table, [], k)
    return history, targets, now


def rated(docs, weights=WEIGHTS, shrinking=None, classifier=None, key="doc_id", text="text", bits=ftrl.BITS, columns=None, total=TOTAL):
    """docs (or some of its columns) as row, with n_tokens, posterior, rate, copies, and the
    targets and reached tokens of the domains.

    copies is the whole part of the rate, and one more if a hash of the key, as a number
    from 0 to 1, is below the rest: the expected copies are the rate, alike on every run.
    """
    table = stored(posteriors(docs, classifier, bits, text), "posteriors")
    history, targets, reached = fit_rates(table, weights, shrinking, total=total)
    shared = docs.sparkSession.sparkContext.broadcast(classifier.astype(np.float32))
    added = [("n_tokens", T.LongType()), ("posterior", T.ArrayType(T.DoubleType())), ("rate", T.DoubleType())]
    names = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["key"], *[T.StructField(n, t) for n, t in added]])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p, lengths = _posteriors(part, shared.value, bits)
                arrays = [part.column("row"), part.column("key"), pa.array(lengths.astype(np.int64))]
                arrays += [pa.array(list(p.T), pa.list_(pa.float64())), pa.array(_rates(p, history))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 11) / F.lit(2.0**53)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    sums = {n: F.array(*[F.lit(float(x)) for x in v]) for n, v in (("targets", targets), ("reached", reached))}
    return rows.mapInArrow(run, schema).withColumns({"copies": copies, **sums}).drop("key")


def mixed_rates(docs, labels, weights=WEIGHTS, shrinking=None, key="doc_id", text="text", total=TOTAL):
    """key, n_tokens, posterior, rate and copies of every document, and in every row the
    target tokens of the domains and those reached, in the order of the weights."""
    classifier = fit_domains(docs, labels, domain_of_labels(), len(weights), key, text)
    out = rated(docs, weights, shrinking, classifier, key, text, columns=[key], total=total)
    return out.select("row.*", "n_tokens", "posterior", "rate", "copies", "targets", "reached")


def mix_documents(docs, labels, weights=WEIGHTS, shrinking=None, key="doc_id", text="text", total=TOTAL):
    """docs with every row as often as its copies say. Columns may have any names."""
    classifier = fit_domains(docs, labels, domain_of_labels(), len(weights), key, text)
    out = rated(docs, weights, shrinking, classifier, key, text, total=total)
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
