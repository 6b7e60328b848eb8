"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding: tasks cut texts into pre-tokens by the pattern and give each document the sequence
of its pre-tokens, as places in its block's list of different ones (see blocks). The lists
are exploded to (bucket, block, words): a word's bucket is a hash of the word, and a row
holds, compressed, all words of one block that go to one bucket, in the order of their
places. A shuffle on the bucket brings all rows of a word together; it is encoded once by its
merges, and its ids join all its rows. A shuffle on the block brings the ids back to the
sequences, which give every place its ids. One shuffle of the blocks serves both sides, so
that neither texts nor sequences are written twice.

A task goes through its buckets one after the other and keeps the ids of one bucket's words
only; beyond KNOWN different words it begins anew, so its memory has a bound, and a word may
then be encoded again.

Decoding: the token-byte table has one row for each token of the vocabulary, which bounds it,
so its join is a broadcast one: every task gathers the bytes of its ids from the table.

Defined results: a null text is an empty one and has no ids; repeated rows and null keys are
documents like any other; an empty table gives an empty table; columns other than key and
text are not read, so their names do not matter; a text that is all one word is one row.
"""

import base64
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from wardflow.llm.blocks import block_number, numbers, reassembled, squeezed, squeezed_texts, strings_of, texts
from wardflow.llm.chunks import chunk_starts, distinct, listed, per_text, strung
from wardflow.llm.words import slices, text_buffer

#: Bytes of text of a block, one document at least.
BLOCK = 1 << 22
#: Rows of a record batch.
AT_ONCE = 1024
#: Buckets of words for each shuffle partition of the session.
BUCKETS = 2
#: Different words that a task keeps with their ids.
KNOWN = 200_000


def default_ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_of(path):
    """{token bytes: id} of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_LOADED = {}


def _encoding(path):
    """One whole-word encoder for each worker: its pattern takes a word as it is."""
    if path not in _LOADED:
        import tiktoken

        _LOADED[path] = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
    return _LOADED[path]


def _by_bucket(buckets):
    """Places in the order of their buckets, and within a bucket in their own order."""
    return np.argsort(buckets, kind="stable")


def pretokens(docs, pattern, n_buckets, size=BLOCK):
    """(block, keys, counts, codes, buckets, words) of docs (key, text): for each document how
    many pre-tokens it has and their places in the block's list of different words, the more
    frequent first; the bucket of each place; and the words of each bucket that has any."""

    def block_of(part, n, cut):
        data, offsets = text_buffer(part.column("text"))
        starts = chunk_starts(data, offsets)
        of, chunks = distinct(data, starts)
        number, values, sizes = {}, array("q"), array("q")
        for chunk in chunks.bytes():
            found = cut(chunk.decode())
            sizes.append(len(found))
            values.extend([number.setdefault(w, len(number)) for w in found])
        sequence, lengths = strung(of, np.array(values, np.int64), np.array(sizes, np.int64))
        order = np.argsort(-np.bincount(sequence, minlength=len(number)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = list(number)
        words = [words[i] for i in order.tolist()]
        buckets = np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words)) % n_buckets
        places = _by_bucket(buckets)
        edges = np.flatnonzero(np.diff(buckets[places], prepend=-1, append=-1))
        packed = [squeezed_texts([words[i] for i in places[a:b].tolist()]) for a, b in zip(edges[:-1], edges[1:])]
        keys = part.column("key").to_pylist()
        row = [
            pa.array([block_number(n, data.tobytes(), repr(keys).encode())], pa.int64()),
            pa.array([keys], pa.list_(pa.int64())),
            pa.array([per_text(starts, offsets, lengths)], pa.list_(pa.int64())),
            pa.array([squeezed(rank[sequence])], pa.binary()),
            pa.array([squeezed(buckets)], pa.binary()),
            pa.array([packed], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(row, names=["block", "keys", "counts", "codes", "buckets", "words"])

    def run(batches):
        cut, n = regex.compile(pattern).findall, 0
        for batch in batches:
            for part in slices(batch, size=size):
                yield block_of(part, n, cut)
                n += 1

    return docs.mapInArrow(run, "block long, keys array<long>, counts array<long>, codes binary, buckets binary, words array<binary>")


def exploded(blocks):
    """(bucket, block, words): a row for each bucket that has words of the block."""

    def run(batches):
        for batch in batches:
            for block, buckets, words in zip(batch.column("block"), batch.column("buckets"), batch.column("words")):
                used = np.unique(numbers(buckets.as_py()))
                column = words.values
                for at in range(0, len(used), AT_ONCE):
                    part = used[at : at + AT_ONCE].astype(np.int32)
                    of = pa.array(np.full(len(part), block.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(part), of, column.slice(at, len(part))], names=["bucket", "block", "words"])

    return blocks.mapInArrow(run, "bucket int, block long, words binary")


def answered(rows, path):
    """(block, code, sizes, ids) of rows (bucket, block, words) sorted by bucket: code is the
    bucket; how many ids each of its words has, and all of them one after the other."""

    def run(batches):
        encoding, known, bucket = _encoding(path), {}, None
        for batch in batches:
            sizes, ids = [], []
            for of, packed in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                words = texts(packed.as_py()).to_pylist()
                if of != bucket or len(known) > KNOWN:
                    known, bucket = {}, of
                for w in words:
                    if w not in known:
                        known[w] = encoding.encode_ordinary(w)
                values, counts = listed([known[w] for w in words])
                sizes.append(squeezed(counts))
                ids.append(squeezed(values))
            columns = [batch.column("block"), batch.column("bucket"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "code", "sizes", "ids"])

    return rows.mapInArrow(run, "block long, code int, sizes binary, ids binary")


def _build(row, answers):
    buckets = numbers(row["buckets"])
    used, each = np.unique(buckets, return_counts=True)
    sizes = [numbers(s.as_py()) for s in answers.column("sizes")]
    if answers.column("code").to_pylist() != used.tolist() or [len(s) for s in sizes] != each.tolist():
        raise RuntimeError("a block and its words were not made from the same rows")
    sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
    flat = np.concatenate([np.zeros(0, np.int64), *(numbers(i.as_py()) for i in answers.column("ids"))])
    place = np.empty(len(buckets), np.int64)
    place[_by_bucket(buckets)] = np.arange(len(buckets))
    ids, lengths = strung(place[numbers(row["codes"])], flat.astype("<u4"), sizes)
    counts = np.array(row["counts"], np.int64)
    ends = 4 * np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.table([pa.array(row["keys"], pa.int64()), strings_of(ends, ids.tobytes(), pa.binary())], names=["key", "ids"])


def encode(docs, key="doc_id", text="text", path=None, pattern=None, size=BLOCK, buckets=None):
    """key and ids (little-endian unsigned 32-bit integers, binary) of every document.

    buckets: how many parts the different words of the whole table are dealt to; each should
    have at most some 100,000 (default: BUCKETS for each shuffle partition). docs must give its
    rows in the same partitions and order whenever they are read, as a table does; otherwise
    repeated tasks may end in an error.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    buckets = buckets or BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    blocks = pretokens(rows, pattern, buckets, size).repartition("block")
    answers = answered(exploded(blocks).repartition("bucket").sortWithinPartitions("bucket"), path)
    return reassembled(blocks, answers, _build, "key long, ids binary").withColumnRenamed("key", key)


def decode(table, ids="ids", decoded="decoded", path=None):
    """table with the bytes of its ids column (packed as by encode); null ids give null. A
    column of the name `decoded` is replaced."""
    path = path or default_ranks()
    names = [c for c in table.columns if c != decoded]
    tokens = [t for t, _ in sorted(ranks_of(path).items(), key=lambda x: x[1])]
    if list(ranks_of(path).values()) != list(range(len(tokens))):
        raise ValueError("ids of the rank file must count from 0 without gaps")
    shared = table.sparkSession.sparkContext.broadcast(tokens)  # as many rows as the vocabulary has

    def run(batches):
        flat = np.frombuffer(b"".join(shared.value), np.uint8)
        sizes = np.array([len(t) for t in shared.value], np.int64)
        for batch in batches:
            for part in slices(batch, ids, BLOCK):
                out = []
                for packed_ids in part.column(ids):
                    found = np.frombuffer(packed_ids.as_py() or b"", "<u4")
                    out.append(strung(found, flat, sizes)[0].tobytes() if packed_ids.is_valid else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*names, decoded])

    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in names) + f", `{decoded}` binary"
    return table.select(*names).mapInArrow(run, schema)


def digests(docs, key="doc_id", text="text", path=None):
    """key, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = decode(encode(docs, key, text, path), path=path)
    size = F.expr("octet_length(ids) div 4").alias("n_tokens")
    return out.select(key, size, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
