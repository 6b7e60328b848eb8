"""Toxicity scores by FTRL-proximal logistic regression (see ftrl).

Defined results: a null or empty text has no feature and gets the score of the bias;
repeated rows are scored each; without labelled rows every score is 0.5, which predicts 1;
an empty table gives an empty table. Only key and text are read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm import ftrl
from wardflow.llm.words import slices


def held_out(key="doc_id", folds=5):
    """Whether a row is kept away from learning: crc32 of the key as text, mod folds, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def fit(docs, labels, key="doc_id", text="text", label="toxic", max_rows=ftrl.MAX_ROWS, bits=ftrl.BITS, **options):
    """Weights from the labelled rows that are not held out, at most max_rows of them."""
    used = labels.filter(~held_out(key))
    features = ftrl.sample(docs, used, F.col(label), key, text, max_rows, bits)
    return ftrl.fit(features, (1,), bits, **options)


def score(docs, weights, key="doc_id", text="text", bits=ftrl.BITS):
    """key, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits numbers

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found, _ = ftrl.scores(part, shared.value, bits)
                keys = part.column("key").to_pylist()
                out = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in keys]
                arrays = [part.column("key"), pa.array(out), pa.array(found[0]), pa.array((found[0] >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def scored_documents(docs, labels, **options):
    """Learn from labels and score all documents."""
    return score(docs, fit(docs, labels, **options))
