"""Token files: flat unsigned integers, 64-bit document offsets, read through memory maps.

A file pair holds a run of documents in ascending key order. `<name>.bin` is nothing but
the ids of all its documents, little-endian, 2 or 4 bytes each. `<name>.idx` is 64-bit
little-endian integers: width, number of documents n, the n keys, n + 1 offsets in ids.
The manifest table has one row for each pair; bases come from prefix sums over it, so the
first id of a document in the whole corpus is its file's base plus its offset.

Files carry the number of the task attempt. Only attempts that Spark commits are in the
manifest, so lost executors and repeated tasks leave files behind but no wrong rows.

Defined results: a null text is an empty one and gets the end id alone; a row without a
key is left out; rows with equal keys follow each other in text order; an empty table
writes no file.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.chunks import ByteLevel, Memory, chunk_starts, distinct, per_text, strung
from wardflow.llm.stages import stored
from wardflow.llm.words import slices, text_buffer
from wardflow.session import new_folder

#: Bytes of text that are encoded together, and documents that are read from files together.
SLICE, AT_ONCE = 1 << 22, 1024


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE of the tokenizers library; each different chunk of a slice is encoded
    once (see chunks). A text that holds an added token is one chunk, because the library
    splits it elsewhere."""

    def __init__(self, path):
        self.tokenizer = ByteLevel(path)
        self.size, self.memory = self.tokenizer.size, Memory(self.tokenizer)

    def _whole(self, data, offsets):
        """Texts that may hold an added token."""
        out = np.zeros(len(offsets) - 1, bool)
        if self.tokenizer.added:
            for found in self.tokenizer.added.finditer(data.tobytes()):
                out[np.searchsorted(offsets, found.start(), "right") - 1] = True
        return out

    def encode_all(self, column, end_id):
        """(ids of all texts one after the other, each with the end id, and how many each has)."""
        data, offsets = text_buffer(column)
        starts = chunk_starts(data, offsets, self._whole(data, offsets))
        of, chunks = distinct(data, starts)
        ids, lengths = strung(of, *self.memory(chunks)[:2])
        counts = per_text(starts, offsets, lengths)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_LOADED = {}


def _encoder(path):
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _store(folder):
    """(file system, path) of a folder name that Spark uses."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs, folder=None, key="doc_id", text="text", end_id=0, path=None):
    """Write the ids of all documents; the manifest (part, name, n_docs, n_tokens, base)."""
    path = path or default_tokenizer()
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def run(batches):
        encoder, store, context = _encoder(path), None, TaskContext.get()
        kind = np.dtype("<u2") if max(encoder.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        keys, lengths, out = [], [], None
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if out is None:
                    store, root = _store(folder)
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.bin")
                ids, counts = encoder.encode_all(part.column("text"), end_id)
                keys.append(part.column("key").to_numpy())
                lengths.append(counts)
                out.write(ids.astype(kind).tobytes())
        if out is None:
            return
        out.close()
        keys, lengths = np.concatenate(keys), np.concatenate(lengths)
        header = np.array([kind.itemsize, len(keys)], "<i8")
        index = np.concatenate([header, keys, [0], np.cumsum(lengths)]).astype("<i8")
        with store.open_output_stream(f"{root}/{name}.idx") as file:
            file.write(index.tobytes())
        row = [[context.partitionId()], [f"{folder}/{name}"], [len(keys)], [int(lengths.sum())]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["part", "name", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null")
    ranged = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    manifest = stored(ranged.mapInArrow(run, "part long, name string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class _Ranges:
    """Ids of a file that is not local, read range by range."""

    def __init__(self, file, kind):
        self.file, self.kind = file, np.dtype(kind)

    def __getitem__(self, span):
        a, b = (x * self.kind.itemsize for x in (int(span.start), int(span.stop)))
        return np.frombuffer(self.file.read_at(b - a, a), self.kind)


def open_pair(name):
    """(keys, offsets, ids) of a file pair: memory maps where the store is local, else the
    index read whole and the ids by ranges."""
    store, root = _store(name)
    local = isinstance(store, fs.LocalFileSystem)
    index = np.memmap(f"{root}.idx", "<i8", "r") if local else np.frombuffer(store.open_input_file(f"{root}.idx").readall(), "<i8")
    kind, n = "<u2" if index[0] == 2 else "<u4", int(index[1])
    ids = np.memmap(f"{root}.bin", kind, "r") if local else _Ranges(store.open_input_file(f"{root}.bin"), kind)
    return index[2 : 2 + n], index[2 + n :], ids


def read_tokens(manifest, key="doc_id", with_ids=False):
    """key, start, n_tokens, ids_crc32 and on demand the ids of every document, from the files."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                keys, offsets, ids = open_pair(name)
                for at in range(0, len(keys), AT_ONCE):
                    to = min(at + AT_ONCE, len(keys))
                    held = ids[offsets[at] : offsets[to]].astype("<u4")
                    cuts = (np.array(offsets[at : to + 1]) - offsets[at]).tolist()
                    spans = [held[a:b] for a, b in zip(cuts, cuts[1:])]
                    checks = [zlib.crc32(s) for s in spans]
                    columns = [
                        pa.array(np.array(keys[at:to])),
                        pa.array(np.array(offsets[at:to]) + base),
                        pa.array([len(s) for s in spans], pa.int64()),
                        pa.array(checks, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = manifest.select("name", "base").repartition("name")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def token_table(docs, folder=None, key="doc_id", text="text", end_id=0, path=None):
    """Write the token files of docs and read them back: key, start, n_tokens, ids_crc32."""
    return read_tokens(stored(write_tokens(docs, folder, key, text, end_id, path), "bases"), key)
