"""Answers for the different things of a block, joined back and put into their places.

A block is what one task cuts from a slice of documents: one row with its different things,
and the sequences of the documents as numbers into them. The things are exploded, one row a
block and thing; each thing is answered in the whole table, by a shuffle on the thing; the
answers come together with the sequences by a shuffle on the block. A thing has at most one row a block, so a frequent word is no hot key,
and a block is bounded by its slice, so no group grows with the table.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F


def block_number(i, *contents):
    """Number of the i-th block of this task, different in every task and for other contents."""
    found = blake2b(TaskContext.get().partitionId().to_bytes(8, "little") + i.to_bytes(8, "little"), digest_size=8)
    for content in contents:
        found.update(content)
    return int.from_bytes(found.digest(), "little", signed=True)


def squeezed(numbers):
    """Bytes of numbers (0 to 2**32 - 1), compressed: first all low bytes, then the next ones."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width])
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def numbers(squeezed_):
    """What squeezed() took, as 64-bit integers."""
    width, size = squeezed_[0], int.from_bytes(squeezed_[1:9], "little")
    if not size:
        return np.zeros(0, np.int64)
    planes = np.zeros((4, size), np.uint8)
    raw = pa.decompress(squeezed_[9:], width * size, "zstd", asbytes=True)
    planes[:width] = np.frombuffer(raw, np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def strings_of(offsets, data, kind):
    """Arrow strings or binaries from their offsets and bytes."""
    offsets = pa.py_buffer(np.ascontiguousarray(offsets, np.int32))
    return pa.Array.from_buffers(kind, offsets.size // 4 - 1, [None, offsets, pa.py_buffer(data)])


def squeezed_texts(texts):
    """Bytes of a list of texts, compressed."""
    raw = [t.encode() for t in texts]
    lengths = squeezed(np.array([len(t) for t in raw], np.int64))
    joined = b"".join(raw)
    packed = pa.Codec("zstd", compression_level=6).compress(joined, asbytes=True)
    return len(lengths).to_bytes(8, "little") + len(joined).to_bytes(8, "little") + lengths + packed


def texts(squeezed_):
    """What squeezed_texts() took, as Arrow strings."""
    to, size = 16 + int.from_bytes(squeezed_[:8], "little"), int.from_bytes(squeezed_[8:16], "little")
    data = pa.decompress(squeezed_[to:], size, "zstd", asbytes=True) if size else b""
    return strings_of(np.concatenate([[0], np.cumsum(numbers(squeezed_[16:to]))]), data, pa.string())


def things(blocks, column, thing):
    """(block, code, thing): a row for each element of the array column; code is its place."""
    return blocks.select("block", F.posexplode(column).alias("code", thing))


def reassembled(blocks, answers, build, schema):
    """build(row of blocks as a dict, answers of the block by rising code as a table) -> table.

    Blocks that lack answers, as when a lost task is done again over rows in another order,
    must make build raise an error.
    """

    def run(left, right):
        right = right.take(pa.array(np.argsort(right.column("code").to_numpy())))
        return pa.concat_tables([build(row, right) for row in left.to_pylist()])

    answers = answers.withColumnRenamed("block", "of")
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
