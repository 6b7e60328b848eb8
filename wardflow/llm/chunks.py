"""Texts cut into chunks that tokenizers treat alike wherever they stand.

A chunk begins at the start of a text, and at each space that has a character other than a
space before it and one that is surely not white space behind it. Byte-level BPE splits a
text there, and no piece of a sentencepiece model with U+2581 at the start of words only
crosses it. So the ids of a text are the ids of its chunks one after the other, each
different chunk of a slice is encoded once, and numpy strings the ids together.

Chunks are told apart by a 64-bit hash of their bytes, in a slice and from slice to slice (in
100 TB of text less than one chunk is expected to be taken for another).
"""

import os
import re
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa

from wardflow.llm.words import _BYTE, _powers, mix

#: Chunks that a worker remembers for each tokenizer.
REMEMBERED = 1_000_000
#: Bytes of chunks that are remembered, and that are hashed many at a time.
SHORT, HASHED = 64, 4096
#: Chunks that go to the library as one text.
JOINED = 64
WINDOW = 21  # bits: bytes that are hashed at once
#: Bytes after a space that may belong to white space: ASCII up to the space, and the first
#: bytes of the blocks that hold the other white space characters.
OPEN = np.zeros(256, bool)
OPEN[:33] = True
OPEN[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunk_starts(data, offsets, whole=None):
    """Starts of all chunks. whole marks texts that stay in one chunk; empty texts have none."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begins[1 : len(data) - 1] = (data[1:-1] == 32) & (data[:-2] != 32) & ~OPEN[data[2:]]
    filled = offsets[:-1] < offsets[1:]
    begins[np.maximum(offsets[1:] - 1, 0)[filled]] = False  # a space at the end has nothing behind it
    if whole is not None:
        for i in np.flatnonzero(whole):
            begins[offsets[i] : offsets[i + 1]] = False
    begins[offsets[:-1][filled]] = True
    return np.flatnonzero(begins[: len(data)])


def distinct(data, starts):
    """(of, chunks): number of the different chunk that each chunk is, and the different ones."""
    n = len(starts)
    ends = np.append(starts[1:], len(data))
    hashes = np.zeros(n, np.uint64)
    long_ = np.flatnonzero(ends - starts > HASHED)
    edges = np.unique(np.concatenate([[0, n], np.flatnonzero(np.diff(starts >> WINDOW)) + 1, long_, long_ + 1]))
    for a, b in zip(edges[:-1], edges[1:]):
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        if b - a == 1 and e[0] > HASHED:
            hashes[a] = int.from_bytes(blake2b(data[starts[a] : ends[a]].tobytes(), digest_size=8).digest(), "little")
            continue
        up, down = _powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_BYTE[data[starts[a] : ends[b - 1]]] * up[: int(e[-1])], out=sums[1:])
        hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    numbered = pa.array(hashes).dictionary_encode()
    of = numbered.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1)) if n else of
    return of, Chunks(data, starts[first], ends[first], hashes[first])


class Chunks:
    """The different chunks of a slice: where the first of each stands, and its hash."""

    def __init__(self, data, starts, ends, hashes):
        self.data, self.starts, self.ends, self.hashes = data, starts, ends, hashes

    def __len__(self):
        return len(self.starts)

    def sizes(self):
        return self.ends - self.starts

    def bytes(self, at=slice(None)):
        """The chunks at these numbers, as a list of bytes."""
        text = self.data.tobytes()
        return [text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def strung(of, values, sizes):
    """(values of every number in the order of `of`, how many each has). values holds those of
    all numbers one after the other, sizes how many each number has."""
    begins = np.cumsum(sizes) - sizes
    lengths = sizes[of]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((begins[of] - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at], lengths


def per_text(starts, offsets, lengths):
    """Sums of the chunks' lengths for each text."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(sums[np.searchsorted(starts, offsets)])


def listed(lists):
    """(all ids one after the other, how many each list has)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class Memory:
    """Ids of chunks, asked once for each different chunk from encode(list of chunks) -> (ids,
    sizes). right(chunks, ids, sizes), if given, is asked about each of them too.

    When more than REMEMBERED chunks are known, those that only one slice had are forgotten.
    """

    def __init__(self, encode, right=None, remembered=REMEMBERED):
        self.encode, self.right_of, self.remembered = encode, right, remembered
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.right, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)

    def _forget(self):
        stays = np.flatnonzero(self.uses[self.place] > 1)
        if 2 * len(stays) > self.remembered:
            stays = stays[:0]
        at, self.known = self.place[stays], self.known[stays]
        self.flat, self.sizes = strung(at, self.flat, self.sizes)
        self.right, self.place, self.uses = self.right[at], np.arange(len(at)), np.ones(len(at), np.int64)

    def __call__(self, chunks):
        """(ids of all chunks one after the other, how many each has, right of each)."""
        if len(self.sizes) > self.remembered or len(self.flat) > 16 * self.remembered:
            self._forget()
        at = np.searchsorted(self.known, chunks.hashes)
        there = np.zeros(len(chunks), bool)
        if len(self.known):
            there = self.known[np.minimum(at, len(self.known) - 1)] == chunks.hashes
        number = np.full(len(chunks), -1)
        number[there] = self.place[at[there]]
        missing = np.flatnonzero(~there)
        if len(missing):
            new = chunks.bytes(missing)
            values, sizes = self.encode(new)
            number[missing] = len(self.sizes) + np.arange(len(new))
            right = np.ones(len(new), bool) if self.right_of is None else self.right_of(new, values, sizes)
            self.flat, self.sizes = np.concatenate([self.flat, values]), np.concatenate([self.sizes, sizes])
            self.right, self.uses = np.concatenate([self.right, right]), np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            short = missing[chunks.sizes()[missing] <= SHORT]
            short = short[np.argsort(chunks.hashes[short])]
            spot = np.searchsorted(self.known, chunks.hashes[short])
            self.known, self.place = np.insert(self.known, spot, chunks.hashes[short]), np.insert(self.place, spot, number[short])
        self.uses[number] += 1
        ids, sizes = strung(number, self.flat, self.sizes)
        return ids, sizes, self.right[number]


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: ids of chunks and bytes of entries.

    Chunks that begin with a space and end with another character are encoded many as one
    text, since the library splits it at their borders; the bytes of the ids tell the chunks
    apart again. Other chunks, and all where that does not come out even, go one by one.
    """

    def __init__(self, path, special=True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.size = self.tokenizer.get_vocab_size()
        self.entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.lengths = np.array([len(e) for e in self.entries], np.int64)  # a character for each byte
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def _ids(self, texts):
        return listed([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _plain(self, chunk):
        return len(chunk) > 1 and chunk[0] == 32 and chunk[-1] != 32 and not OPEN[chunk[1]] and not (self.added and self.added.search(chunk))

    def __call__(self, chunks):
        """(ids of all chunks one after the other, how many each has)."""
        plain = np.fromiter(map(self._plain, chunks), bool, len(chunks))
        joined = [c for c, p in zip(chunks, plain.tolist()) if p]
        texts = [b"".join(joined[i : i + JOINED]).decode() for i in range(0, len(joined), JOINED)]
        values, _ = self._ids(texts)
        ends = np.cumsum(self.lengths[values])
        borders = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        cuts = np.searchsorted(ends, borders) + 1
        if len(joined) and (cuts[-1] != len(ends) or not np.array_equal(ends[cuts - 1], borders)):
            return self._ids([c.decode() for c in chunks])
        more, more_sizes = self._ids([c.decode() for c, p in zip(chunks, plain.tolist()) if not p])
        order = np.argsort(np.argsort(~plain, kind="stable"))
        return strung(order, np.concatenate([values, more]), np.concatenate([np.diff(cuts, prepend=0), more_sizes]))
