"""Substring dedup: repeated word windows found by prefix-partitioned suffix trees.

A window is `window` consecutive words of one text. A word goes if a window over it also
starts in a text with a smaller id, judged on the texts as they come.

* Suffixes. A window holds `window - PREFIX + 1` prefixes of PREFIX words; the one with the
  smallest hash, the leftmost of equals, is its anchor. Equal windows have equal anchors at
  equal offsets, so only suffixes that begin at an anchor enter a tree, about one in twenty,
  and every window belongs to one of them. A sparse suffix tree over them, together with the
  words to the left, finds every repeat.
* Partitions. Suffixes are split by their prefix. Prefixes that occur in one place, or in
  one text, are left out. Occurrences with the same words around the anchor, as far as its
  windows go, are one leaf with the smallest id, so copies cost nothing.
* Trees. Leaves are sorted by the words after the anchor, and by the words before it read
  backwards. Neighbours that share d words are in one node of depth d. A window that begins
  o words before the anchor is a node of depth window - o in the first tree and of depth o
  in the second; the nodes with leaves of two texts or more are the repeats, and the
  smallest id below a node decides.
* Memory. A prefix with more leaves than LEAVES is split by the longest prefix there is,
  the whole window: smallest ids per window come from an aggregate that combines on the map
  side and has no hot group.

Defined results: null texts have no words; texts shorter than a window lose none; a row
without an id neither loses words nor takes any from others; equal rows lose the same words;
rows with one id and different texts are told apart by a 64-bit hash, and each loses its own
repeats; an empty table gives an empty table. Other columns are not read. A window has PREFIX
to 32,767 words; others raise a ValueError.
"""

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from wardflow.llm.stages import repeated_keys, stored
from wardflow.llm.words import grams, mix, slices, text_buffer, words

WINDOW = 50
PREFIX = 8
#: Leaves that one tree holds, and about as many meet in one pass of a task.
LEAVES = 8192
#: Bits of an offset beside the place of an anchor.
FIELD = 15
#: Windows of one text that are looked at together.
RUN = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPAN = np.uint64(0xD6E8FEB86659FD93)


def _anchors(hashes, first, window, prefix):
    """(text, anchor, smallest offset, largest offset): all anchors with the windows they own."""
    found = []
    width = window - prefix + 1
    for a in range(0, len(hashes), RUN):
        b = min(a + RUN + window - 1, len(hashes))
        inside = np.clip(first, a, b) - a
        prefixes, whole = grams(hashes[a:b], inside, prefix)
        _, starts = grams(hashes[a:b], inside, window)
        if b - a < width:
            continue
        low = np.where(whole, prefixes, np.uint64(2**64 - 1))
        at = sliding_window_view(low, width).argmin(1) + np.arange(b - a - width + 1)
        start = np.flatnonzero(starts[: len(at)])
        start = start[start < RUN]
        at = at[start]
        border = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[border[1:] - 1, len(at) - 1][: len(border)]
        found.append(np.stack([at[border] + a, at[border] - start[last], at[border] - start[border]]))
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return np.searchsorted(first, out[0], "right") - 1, *out


def _context_hash(hashes, begins, ends, offsets):
    """Hash of the words from begins to ends and of where the anchor stands in them."""
    out = np.zeros(len(begins), np.uint64)
    for a in range(0, len(begins), 4096):
        b, e = begins[a : a + 4096], ends[a : a + 4096]
        if not len(b):
            continue
        width = int((e - b).max())
        at = b[:, None] + np.arange(width)
        inside = at < e[:, None]
        part = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], 0)
        powers = np.array([pow(_BASE, i, 2**64) for i in range(width)], np.uint64)
        out[a : a + 4096] = (part * powers).sum(1)
    return mix(out ^ mix(offsets.astype(np.uint64) * _SPAN + (ends - begins).astype(np.uint64)))


def anchors(docs, window=WINDOW, prefix=PREFIX):
    """(g, ctx, doc, version, spot) of every anchor of docs (id, text, version): prefix hash,
    hash of the words of all its windows, id, and place of the anchor with smallest and
    largest offset."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                _, _, hashes, first = words(data, offsets)
                text, at, low, high = _anchors(hashes, first, window, prefix)
                g, _ = grams(hashes, first, prefix)
                ctx = _context_hash(hashes, at - high, at - low + window, high)
                ids, versions = (part.column(c).to_numpy()[text] for c in ("id", "version"))
                spot = (at - first[text]) << 2 * FIELD | low << FIELD | high
                columns = [g[at].view(np.int64), ctx.view(np.int64), ids, versions, spot]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "ctx", "doc", "version", "spot"])

    return docs.mapInArrow(run, "g long, ctx long, doc long, version long, spot long")


def _contexts(rows, window):
    """(g, ctx, doc, last, spot, words) for rows of texts with the spots to cut out."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[], [], [], [], [], []]
                data, offsets = text_buffer(part.column("text"))
                for a, b, doc, spots in zip(offsets, offsets[1:], part.column("doc").to_pylist(), part.column("spots").to_pylist()):
                    found = data[a:b].tobytes().split()
                    for s in spots:
                        at, (low, high) = s["spot"] >> 2 * FIELD, _spots(s["spot"])
                        cut = found[at - high : at - low + window]
                        if len(cut) == high - low + window:
                            for column, value in zip(out, (s["g"], s["ctx"], doc, s["last"], s["spot"], b" ".join(cut).decode())):
                                column.append(value)
                kinds = [pa.int64()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["g", "ctx", "doc", "last", "spot", "words"])

    return rows.mapInArrow(run, "g long, ctx long, doc long, last long, spot long, words string")


def _matrices(column, low, high, window):
    """Words after the anchor and words before it, backwards; missing ones equal nothing."""
    data, offsets = text_buffer(column)
    _, _, hashes, first = words(data, offsets)
    n = len(low)
    hashes = np.append(hashes, np.uint64(0))
    odd = mix(np.arange(n * 2 * window, dtype=np.uint64) + np.uint64(1) << np.uint64(20))
    anchor = first[:-1] + high
    j = np.arange(window)
    after, before = anchor[:, None] + j, anchor[:, None] - 1 - j
    right = np.where(j < (window - low)[:, None], hashes[np.minimum(after, len(hashes) - 1)], odd[: n * window].reshape(n, window))
    left = np.where(j < high[:, None], hashes[np.maximum(before, 0)], odd[n * window :].reshape(n, window))
    return right, left


def _tree(group, strings, depth):
    """(order, shared): leaves sorted within their groups and the words that each shares with
    the leaf before it, -1 where the group begins. Nodes of depth d are runs of shared >= d."""
    order = np.lexsort([*(strings[:, j] for j in range(depth - 1, -1, -1)), group])
    sorted_, groups = strings[order, :depth], group[order]
    shared = np.full(len(order), -1)
    same = (sorted_[1:] == sorted_[:-1]).cumprod(axis=1).sum(axis=1)
    shared[1:] = np.where(groups[1:] == groups[:-1], same, -1)
    return order, shared


def _nodes(order, shared, depth):
    """Number of the node of this depth above each leaf."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def smallest_ids(group, doc, low, high, column, window=WINDOW, prefix=PREFIX):
    """Smallest id of each window: a row for each leaf, a column for each offset (else -1)."""
    right, left = _matrices(column, low, high, window)
    after, before = _tree(group, right, window), _tree(group, left, window - prefix)
    out = np.full((len(doc), window - prefix + 1), -1, np.int64)
    for o in range(window - prefix + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows):
            pairs = _nodes(*after, window - o)[rows] * (len(doc) + 1) + _nodes(*before, o)[rows]
            _, node = np.unique(pairs, return_inverse=True)
            least = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, doc[rows])
            out[rows, o] = least[node]
    return out


def _runs(table, low, high):
    """(row, first offset, last offset, id) of equal neighbours in a table of smallest_ids."""
    n, width = table.shape
    inside = (np.arange(width) >= low[:, None]) & (np.arange(width) <= high[:, None])
    begins = inside.copy()
    begins[:, 1:] &= ~inside[:, :-1] | (table[:, 1:] != table[:, :-1])
    closes = inside.copy()
    closes[:, :-1] &= ~inside[:, 1:] | (table[:, 1:] != table[:, :-1])
    row, a = np.nonzero(begins)
    _, b = np.nonzero(closes)
    return row, a, b, table[row, a]


def _spots(spot):
    return spot >> FIELD & (1 << FIELD) - 1, spot & (1 << FIELD) - 1


def _grow(contexts, window, prefix):
    """(g, ctx, a, b, least): windows at offsets a to b of the leaf (g, ctx) start in `least`."""
    schema = "g long, ctx long, a long, b long, least long"

    def solve(table):
        columns = {c: table.column(c).to_numpy() for c in ("g", "ctx", "doc", "last", "spot")}
        low, high = _spots(columns["spot"])
        _, group = np.unique(columns["g"], return_inverse=True)
        least = smallest_ids(group, columns["doc"], low, high, table.column("words"), window, prefix)
        row, a, b, first = _runs(least, low, high)
        keep = first < columns["last"][row]
        row, a, b, first = row[keep], a[keep], b[keep], first[keep]
        arrays = [columns["g"][row], columns["ctx"][row], a, b, first]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["g", "ctx", "a", "b", "least"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= LEAVES:
                g = held.column("g").to_numpy()
                cut = int(np.searchsorted(-(g != g[-1]).astype(int), 0))  # the last group may go on
                if cut:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None:
            yield solve(held.combine_chunks())

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _whole_windows(contexts, window, prefix):
    """As _grow, by an aggregate over whole windows, for prefixes with very many leaves."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, offsets = text_buffer(part.column("words"))
                _, _, hashes, first = words(data, offsets)
                one, whole = grams(hashes, first, window)
                two, _ = grams(mix(hashes + _SPAN), first, window)
                start = np.flatnonzero(whole)
                row = np.searchsorted(first, start, "right") - 1
                _, high = _spots(part.column("spot").to_numpy())
                offset = high[row] - (start - first[row])
                columns = [one[start].view(np.int64), two[start].view(np.int64), *(part.column(c).to_numpy()[row] for c in ("g", "ctx", "doc", "last")), offset]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "g", "ctx", "doc", "last", "a"])

    rows = stored(contexts.mapInArrow(run, "h1 long, h2 long, g long, ctx long, doc long, last long, a long"), "windows")
    keys = ["h1", "h2", "g", "a"]
    least = rows.groupBy(*keys).agg(F.min("doc").alias("least"))
    found = rows.join(least, keys).filter("least < last")
    return found.select("g", "ctx", "a", F.col("a").alias("b"), "least")


def spans(docs, key="doc_id", text="text", window=WINDOW, prefix=PREFIX, leaves=LEAVES):
    """(id, version, from, to): words from..to - 1 of the text with this hash are in windows
    that also start in a text with a smaller id. Spans of one text may overlap."""
    if not prefix <= window < 1 << FIELD:
        raise ValueError(f"a window has {prefix} to {(1 << FIELD) - 1} words")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version")).filter("id is not null")
    table = stored(anchors(rows, window, prefix), "anchors")
    shared = stored(repeated_keys(table, "g", ["doc", "spot"]), "shared")
    classes = shared.groupBy("g", "ctx").agg(F.min(F.struct("doc", "version", "spot")).alias("rep"), F.max("doc").alias("last"))
    classes = stored(classes.select("g", "ctx", "rep.*", "last"), "leaves")
    groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("_low"), F.max("last").alias("_high"))
    groups = stored(groups.filter("_low < _high").select("g", "n"), "groups")  # a plain join can split a hot prefix
    several = stored(classes.join(groups, "g"), "several")

    field = (1 << FIELD) - 1
    alone = several.filter("n = 1").select("g", "ctx", *[(F.shiftright("spot", s).bitwiseAND(F.lit(field))).alias(c) for c, s in (("a", FIELD), ("b", 0))], F.col("doc").alias("least"))
    wanted = several.filter("n > 1").groupBy("doc", "version").agg(F.collect_list(F.struct("g", "ctx", "spot", "last", "n")).alias("spots"))
    same = (rows["id"] == wanted["doc"]) & (rows["version"] == wanted["version"])
    cut = _contexts(rows.join(wanted, same).select("doc", "text", "spots"), window)
    contexts = stored(cut, "contexts")
    sizes = several.filter("n > 1").select("g", "n").distinct()
    small = contexts.join(sizes.filter(F.col("n") <= leaves), "g", "left_semi")
    large = contexts.join(sizes.filter(F.col("n") > leaves), "g", "left_semi")
    found = alone.unionByName(_grow(small, window, prefix)).unionByName(_whole_windows(large, window, prefix))
    members = shared.join(found, ["g", "ctx"]).filter("least < doc")
    at = F.shiftright("spot", 2 * FIELD)
    return members.select(F.col("doc").alias("id"), "version", (at - F.col("b")).alias("from"), (at - F.col("a") + window).alias("to"))


def _cleaned(docs, key, text, last, finish, **options):
    """key, n_words, n_removed and the column `last`: finish(bytes of the kept words)."""
    found = spans(docs, key, text, **options).groupBy("id", "version").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.join(found, (rows["key"] == found["id"]) & (rows["hash"] == found["version"]), "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                total, removed, kept = [], [], []
                for a, b, cuts in zip(offsets, offsets[1:], part.column("spans")):
                    split = data[a:b].tobytes().split()
                    total.append(len(split))
                    if cuts.is_valid:
                        gone = np.zeros(len(split) + 1, np.int64)
                        for side, step in (("from", 1), ("to", -1)):
                            np.add.at(gone, np.minimum(cuts.values.field(side).to_numpy(), len(split)), step)
                        split = [w for w, cover in zip(split, np.cumsum(gone).tolist()) if not cover]
                    removed.append(total[-1] - len(split))
                    kept.append(finish(b" ".join(split)))
                arrays = [part.column("key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_words", "n_removed", last])

    out = rows.select("key", "text", "spans").mapInArrow(run, f"key long, n_words long, n_removed long, {last} string")
    return out.withColumnRenamed("key", key)


def without_repeats(docs, key="doc_id", text="text", **options):
    """key, n_words, n_removed and kept, the words that stay joined by one space."""
    return _cleaned(docs, key, text, "kept", bytes.decode, **options)


def digests(docs, key="doc_id", text="text", **options):
    """key, n_words, n_removed and kept_sha256 of every document."""
    return _cleaned(docs, key, text, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest(), **options)
