"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+`
on code points too. Everything works on slices of bounded size, so the memory of a task
does not depend on the size of a record batch; a single text is read in blocks.
"""

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Space and ASCII punctuation, and ASCII letters in lower case: the borders and bytes of tokens.
PUNCTUATION = SPACE | np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {}


def _powers(n):
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            _POWERS[name] = np.multiply.accumulate(line)
    return _POWERS["up"], _POWERS["down"]


def mix(h):
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column):
    """(bytes, offsets) of an Arrow string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column="text", size=BLOCK):
    """Row ranges of a record batch with about `size` bytes of text each, one row at least."""
    _, offsets = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _cut(data, offsets, at, size, space):
    """End of the block that begins at `at`: a space or a text border after `size` bytes."""
    end, stop = int(offsets[-1]), at + size
    if stop >= end:
        return end
    border = int(offsets[np.searchsorted(offsets, stop)])
    while stop < border:
        found = np.flatnonzero(space[data[stop : min(stop + 65536, border)]])
        if len(found):
            return stop + int(found[0])
        stop += 65536
    return border


def words(data, offsets, size=BLOCK, borders_at=SPACE, fold=None):
    """(starts, ends, hashes, first): all words; words first[i] to first[i + 1] are of text i.

    The hash is a mixed polynomial of the bytes, after fold if given, and depends on
    nothing else. borders_at marks the bytes between words.
    """
    starts, ends, hashes, at = [], [], [], 0
    total = int(offsets[-1])
    while at < total:
        to = _cut(data, offsets, at, size, borders_at)
        block = data[at:to]
        space = borders_at[block]
        begins, closes = ~space, ~space
        begins[1:] &= space[:-1]
        closes[:-1] &= space[1:]
        borders = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        borders = borders[borders > 0]
        begins[borders] = ~space[borders]
        closes[borders - 1] = ~space[borders - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        up, down = _powers(to - at + 1)
        block = block if fold is None else fold[block]
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_BYTE[block] * up[: to - at], out=sums[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        at = to
    none = np.zeros(0, np.int64)
    starts = np.concatenate(starts) if starts else none
    ends = np.concatenate(ends) if ends else none
    hashes = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def grams(hashes, first, n):
    """Hash of the n words that begin at each word; valid is False where the text ends before."""
    m = len(hashes)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        part = np.zeros(m, np.uint64)
        part[: max(m - k, 0)] = hashes[k:]
        out = out * np.uint64(_BASE) + part
    last = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(m) + n <= last
