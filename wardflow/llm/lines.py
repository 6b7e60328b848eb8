"""Line dedup: near-equal lines by MinHash, one line of each component stays.

A line is what stands between newlines, without white space at its ends; blank lines are
left as they are. Lines are near if the Jaccard similarity of their sets of SHINGLE
characters is THRESHOLD or more (a shorter line is one shingle). Signatures of BANDS x ROWS
minima, made as a fast similarity sketch in a few rounds over a line's shingles, are banded, so
a pair at the threshold meets with probability 1 - (1 - t**ROWS)**BANDS = 0.99, and more above
it. Band keys travel packed, many to a row, to the task of their range of keys, which gives on
only the lines that meet another one.

Equal lines are one row from then on. Pairs that meet are compared in two rounds. First all
rows of a bucket with one of them, the line with the most copies (in blocks of documents); these links join nearly
all of a group of copies. Then buckets that still hold lines of different components, one
of those with the same lines, are cut into blocks of at most about BLOCK lines, and a task compares two blocks by counting the
shingles that lines share, with links of a spanning forest as its only output. So every pair
that meets is either compared exactly or already joined, and no bucket gives its pairs as
rows. Components come from distributed union-find, and the first line of each,
by document and place, stays.

Defined results: a null text has no lines; a row without an id takes no part and stays; of rows
with one id each different text is a document of its own, told apart by a 64-bit hash; an empty
table gives an empty table. Shingles are compared as 64-bit hashes. Lines are equal if their 64-bit hashes are (for n different
lines one false pair is expected in 2**65 / n**2 runs).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.components import components
from wardflow.llm.stages import stored
from wardflow.llm.words import _powers, mix, slices, text_buffer

#: Characters of a shingle. It decides with THRESHOLD which lines are near, so it is part of
#: the result; what unrelated lines cost is set by ROWS and BANDS alone.
SHINGLE = 5
THRESHOLD = 0.8
#: Lines of a block, and shingles that a task counts at once.
BLOCK, COLUMNS = 1024, 4096
#: Lines of a block that are compared pair by pair.
FEW = 8
#: Hashes and lines that are turned at once, and keys that are packed or held at once.
CELLS, CELL_LINES, PACKED = 1 << 15, 256, 1 << 20
#: More rows make buckets of unrelated lines rarer; bands then keep the 0.99 at the threshold.
BANDS, ROWS = 16, 6
#: Odd, so each of them reorders all hashes: those of the rounds, and those of the bins that no round filled.
_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TURNS = _random.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_EMPTY, _HALF, _SPARE = np.uint32(2**32 - 1), np.uint64(32), np.uint32(5)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLANE = []


def _minima(hashes, starts):
    """BANDS x ROWS minima of each line's hashes, one row for each line, as a fast similarity sketch.

    In a round every hash falls into one bin; a bin keeps the least value of the first round that
    reached it, and after the last round a bin still empty takes the least value of all hashes
    under its own factor. So a bin of two lines is equal with the probability of their Jaccard
    similarity, as with a factor for each bin, but a line costs a few rounds, not one for each bin.
    """
    bins, n, total, a = BANDS * ROWS, len(starts), len(hashes), 0
    out, lengths = np.full((n, bins), _EMPTY, np.uint32), np.diff(np.append(starts, total))
    while a < n:  # about CELLS hashes (or one line) at once stay in the cache of a core
        b = min(a + CELL_LINES, max(a + 1, int(np.searchsorted(starts, starts[a] + CELLS, "right")) - 1), n)
        held, table = hashes[starts[a] : starts[b] if b < n else total], out[a:b].reshape(-1)
        base = np.repeat(np.arange(b - a) * bins, lengths[a:b])
        for turn, factor in enumerate(_TURNS):
            turned = held * factor
            value = turned.astype(np.uint32)
            value >>= _SPARE
            value |= np.uint32(turn << 27)
            turned >>= _HALF
            turned *= np.uint64(bins)
            turned >>= _HALF
            at = turned.view(np.int64)
            at += base
            np.minimum.at(table, at, value)
            open_ = (out[a:b] == _EMPTY).any(axis=1)
            if not open_.any():
                break
            stay = open_[base // bins]
            held, base = held[stay], base[stay]
        else:
            line, bin_ = np.nonzero(out[a:b] == _EMPTY)
            size = lengths[a:b][line]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(starts[a:b][line] - (ends - size), size)
            value = (hashes[at].astype(np.uint32) * np.repeat(_FACTORS[bin_], size)) >> _SPARE
            out[a:b][line, bin_] = np.minimum.reduceat(value, ends - size) | np.uint32(_TURNS.size << 27)
        a = b
    return out


def _mixed(points):
    """mix() of each code point; those of the first plane from a table."""
    if not len(_PLANE):
        _PLANE.append(mix(np.arange(1 << 16, dtype=np.uint64) + _STEP))
    if len(points) and points.max() >= 1 << 16:
        return mix(points.astype(np.uint64) + _STEP)
    return _PLANE[0][points]


def _sums(mixed):
    """Running sums that give the hash of any run of code points."""
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed * _powers(len(mixed) + 1)[0][: len(mixed)], out=sums[1:])
    return sums


def _shingle_hashes(sums, starts, ends):
    """(hashes, first): 64-bit hashes of the shingles of each run, repeats included; those of run i begin at first[i]."""
    counts = np.maximum(ends - starts - SHINGLE + 1, 1)
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(starts - first, counts)
    size, down = max(len(sums) - SHINGLE, 0), _powers(len(sums))[1]
    hashes = mix((sums[SHINGLE:] - sums[:size]) * down[:size]).take(at, mode="clip") if size else np.zeros(len(at), np.uint64)
    short = np.flatnonzero(ends - starts < SHINGLE)
    hashes[first[short]] = mix((sums[ends[short]] - sums[starts[short]]) * down[starts[short]])
    return hashes, first


def _points(texts):
    """(code points of all texts, starts, ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in texts])
    return points, np.r_[0, ends[:-1]], ends


def _shingle_sets(texts):
    """Sorted different shingle hashes of each text."""
    points, starts, ends = _points(texts)
    hashes, first = _shingle_hashes(_sums(_mixed(points)), starts, ends)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(hashes)]):
        one = np.sort(hashes[a:b])
        out.append(one[np.r_[True, one[1:] != one[:-1]]])
    return out


class _Lines:
    """Lines of a record batch: row, place, and the characters of those that are not blank."""

    def __init__(self, part):
        data, offsets = text_buffer(part.column("text"))
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        breaks = np.flatnonzero(points == 10)
        starts, ends = np.r_[0, breaks + 1], np.r_[breaks, len(points)]
        counts = np.array([t.count("\n") + 1 for t in texts])
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        solid = np.flatnonzero((points > 32) | (points < 9) | ((points > 13) & (points < 32)))
        if len(solid):
            a = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
            b = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
            full = (a >= starts) & (a < ends)
        else:
            a, b, full = starts, starts, np.zeros(len(starts), bool)
        self.row, self.place, self.starts, self.ends = row[full], place[full], a[full], b[full]
        self.sums = _sums(_mixed(points))

    def ids(self):
        """64-bit hash of each line as a signed long."""
        length = (self.ends - self.starts).astype(np.uint64)
        down = _powers(len(self.sums))[1]
        return mix((self.sums[self.ends] - self.sums[self.starts]) * down[self.starts] + length).view(np.int64)

    def bands(self, which):
        """Band keys of the lines at the places `which`, one row for each line."""
        if not len(which):
            return np.zeros((0, BANDS), np.uint64)
        minima = _minima(*_shingle_hashes(self.sums, self.starts[which], self.ends[which]))
        minima = minima.reshape(len(which), BANDS, ROWS)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(which), 1))
        for k in range(ROWS):
            keys = mix(keys * _STEP + minima[:, :, k])
        return keys


def _batch(arrays, names):
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names=names)


def _packed(parts, at, *columns):
    """(part, bytes of the columns) for each of the parts that the rows are dealt to by at."""
    order = np.argsort(at, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(at[order], np.arange(parts + 1))
    return [(i, b"".join(c[a:b].tobytes() for c in columns)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


def _unpacked(data, kinds):
    """The columns that _packed() took."""
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at).copy())  # the copy is aligned
        at += out[-1].nbytes
    return out


def _dealt(rows, parts):
    """(part, kind, data): places and band keys of every line of rows (id, text, version), packed by parts.

    A line goes by the hash of its place, a band key by itself, so neither a line nor a document is hot.
    """

    def packed(places, keys):
        line, doc, version, place = (np.concatenate(c) for c in zip(*places))
        spot = mix(mix(doc.view(np.uint64) + _STEP * place.astype(np.uint64)) + line.view(np.uint64))
        out = [(i, 0, x) for i, x in _packed(parts, _part(spot, parts), line, doc, version, place)]
        key, line, copies = (np.concatenate(c) for c in zip(*keys))
        out += [(i, 1, x) for i, x in _packed(parts, _part(key, parts), key, line, copies)]
        part, kind, data = zip(*out) if out else ((), (), ())
        return _batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])

    def run(batches):
        places, keys, size = [], [], 0
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                lines = _Lines(part)
                ids = lines.ids()
                doc, version = (part.column(c).to_numpy()[lines.row] for c in ("id", "version"))
                places.append((ids, doc, version, lines.place))
                line, first, copies = np.unique(ids, return_index=True, return_counts=True)
                key, copies = lines.bands(first), np.minimum(copies, 65535).astype(np.uint16)
                keys.append((key.ravel(), np.repeat(line, BANDS), np.repeat(copies, BANDS)))
                size += key.size
                if size >= PACKED:
                    yield packed(places, keys)
                    places, keys, size = [], [], 0
        if places:
            yield packed(places, keys)

    return rows.mapInArrow(run, "part int, kind int, data binary")


def _part(hashes, parts):
    return ((hashes >> _HALF) * np.uint64(parts) >> _HALF).astype(np.int64)


class _Buckets:
    """Lines of a part's keys, as they come; rows (key, line, pivot, more) of keys with two lines or more.

    Of a key that has given its pivot only the pivot is held, so a key with very many lines
    takes no more memory than any other.
    """

    def __init__(self):
        self.held, self.new, self.size, self.limit = None, [], 0, PACKED

    def add(self, key, line, copies):
        self.new.append((key, line, copies.astype(np.int64), np.zeros(len(key), bool)))
        self.size += len(key)
        if self.size >= self.limit:
            yield from self.rows(last=False)

    def rows(self, last=True):
        parts = ([self.held] if self.held else []) + self.new
        if not parts:
            return
        key, line, copies, pivot = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[1:] = same
        again[:-1] |= same
        single, order = order[~again], order[again]
        order = order[np.lexsort((line[order], key[order]))]
        key_, line_, copies_, pivot_ = key[order], line[order], copies[order], pivot[order]
        if len(order):  # a line once for each key, with all its copies
            cuts = np.flatnonzero(np.r_[True, (key_[1:] != key_[:-1]) | (line_[1:] != line_[:-1])])
            key_, line_ = key_[cuts], line_[cuts]
            copies_, pivot_ = np.add.reduceat(copies_, cuts), np.logical_or.reduceat(pivot_, cuts)
            order = np.lexsort((line_, -copies_, ~pivot_, key_))  # the pivot first: an old one, or the line with most copies
            key_, line_, copies_, pivot_ = key_[order], line_[order], copies_[order], pivot_[order]
            cuts = np.flatnonzero(np.r_[True, key_[1:] != key_[:-1]])
            n = np.diff(np.append(cuts, len(key_)))
            rest = np.ones(len(key_), bool)
            rest[cuts] = False
            more = np.repeat((n > 2) | pivot_[cuts] | (not last), n)
            yield key_[rest], line_[rest], np.repeat(line_[cuts], n)[rest], more[rest]
            key_, line_, copies_, pivot_ = key_[cuts], line_[cuts], copies_[cuts], pivot_[cuts] | (n > 1)
        if last:
            self.__init__()
        else:
            first = key_, line_, copies_, pivot_
            self.held = tuple(np.concatenate([x[single], y]) for x, y in zip((key, line, copies, pivot), first))
            self.new, self.size = [], len(self.held[0])
            self.limit = max(PACKED, 2 * self.size)


def _gathered(rows):
    """Rows of places (line, doc, version, place) and of buckets (key, line, pivot, more) from what _dealt() packed."""
    names = ["key", "line", "pivot", "more", "doc", "version", "place"]

    def bucket(key, line, pivot, more):
        return _batch([key.view(np.int64), line, pivot, more, *[pa.nulls(len(key), pa.int64())] * 3], names)

    def run(batches):
        found, at = _Buckets(), None
        for batch in batches:
            for part, kind, data in zip(*(batch.column(c) for c in ("part", "kind", "data"))):
                if part.as_py() != at:
                    at = part.as_py()
                    yield from (bucket(*x) for x in found.rows())
                if kind.as_py():
                    yield from (bucket(*x) for x in found.add(*_unpacked(data.as_buffer(), (np.uint64, np.int64, np.uint16))))
                else:
                    line, *spot = _unpacked(data.as_buffer(), [np.int64] * 4)
                    none, no = pa.nulls(len(line), pa.int64()), pa.nulls(len(line), pa.bool_())
                    yield _batch([none, line, none, no, *spot], names)
        yield from (bucket(*x) for x in found.rows())

    return rows.mapInArrow(run, "key long, line long, pivot long, more boolean, doc long, version long, place long")


def _texts(rows):
    """(line, text) of the wanted (place, line) of rows (text, wanted)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, size=1 << 20):
                ids, texts = [], []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    found = text.split("\n")
                    for x in wanted:
                        ids.append(x["line"])
                        texts.append(found[x["place"]].strip(" \t\x0b\x0c\r"))
                yield _batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["line", "text"])

    return rows.mapInArrow(run, "line long, text string")


def shingles(text, n=SHINGLE):
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def _near(one, two, threshold):
    """Whether two sorted sets of hashes have this Jaccard similarity."""
    if min(len(one), len(two)) < threshold * max(len(one), len(two)):
        return False
    both = np.concatenate([one, two])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same >= threshold * (len(one) + len(two) - same)


def _verified(pairs, texts, threshold):
    """The pairs (u, v) whose texts are near."""
    both = pairs.join(texts.select(F.col("line").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(texts.select(F.col("line").alias("v"), F.col("text").alias("b")), "v")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "a", size=1 << 17):
                v, keep = part.column("v").to_numpy(), []
                new = np.r_[True, v[1:] != v[:-1]]  # a pivot's rows stand together
                ones = _shingle_sets(part.column("a").to_pylist())
                twos = _shingle_sets(part.column("b").filter(pa.array(new)).to_pylist())
                for one, at in zip(ones, (np.cumsum(new) - 1).tolist()):
                    keep.append(_near(one, twos[at], threshold))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ordered = both.select("u", "v", "a", "b").sortWithinPartitions("v")
    return ordered.mapInArrow(run, "u long, v long")


def _forest(sets, sides, roots, threshold):
    """Links (i, j) that join near sets of different roots; with two sides, only across them."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], float)
    _, column, counts = np.unique(np.concatenate([np.array(s if isinstance(s, np.ndarray) else list(s)) for s in sets]), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), sizes.astype(np.int64)), counts > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    total = int(shared.sum())
    same = np.zeros((n, n), np.float32)
    for at in range(0, total, COLUMNS):
        part = (column >= at) & (column < at + COLUMNS)
        held = np.zeros((n, min(COLUMNS, total - at)), np.float32)
        held[row[part], column[part] - at] = 1
        same += held @ held.T
    same = same.astype(float)
    near = same >= threshold * (sizes[:, None] + sizes - same)
    if sides.min() != sides.max():
        near &= sides[:, None] != sides
    near &= roots[:, None] != roots
    out, left = [], np.ones(n, bool)
    for start in range(n):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            out += [(i, j) for j in found.tolist()]
            queue += found.tolist()
    return out


def _few(sets, sides, roots, threshold):
    """_forest() of a few sorted sets of hashes, pair by pair."""
    n, crossing, out, group = len(sets), sides.min() != sides.max(), [], list(range(len(sets)))
    for i in range(n):
        for j in range(i + 1, n):
            if group[i] == group[j] or roots[i] == roots[j] or (crossing and sides[i] == sides[j]):
                continue
            if _near(sets[i], sets[j], threshold):
                out.append((i, j))
                group = [group[i] if g == group[j] else g for g in group]
    return out


def _compared(open_, texts, threshold):
    """Links between the lines of each bucket of open_ (key, line, root)."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = open_.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "line", "root")
    rows = rows.join(texts, "line").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    names = ["key", "x", "y"]

    def solve(table):
        lines_, sets = table.column("line").to_numpy(), _shingle_sets(table.column("text").to_pylist())
        sides, roots = table.column("block").to_numpy(), table.column("root").to_numpy()
        found = (_few if len(sets) <= FEW else _forest)(sets, sides, roots, threshold)
        return [(lines_[i], lines_[j]) for i, j in found]

    def run(batches):
        held, out = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in names])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.r_[0, cuts], cuts):  # the last group may go on
                out += solve(held.slice(a, b - a)) if b - a > 1 else []
            held = held.slice(cuts[-1]) if len(cuts) else held
            u, v = ([int(p[k]) for p in out] for k in (0, 1))
            out = []
            yield _batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if held is not None and held.num_rows > 1:
            u, v = (np.array([p[k] for p in solve(held)], np.int64) for k in (0, 1))
            yield _batch([u, v], ["u", "v"])

    return rows.select(*names, "block", "line", "root", "text").mapInArrow(run, "u long, v long")


def _links(buckets, texts, threshold):
    """(line, root) for lines that are near another one."""
    pairs = buckets.select(F.col("line").alias("u"), F.col("pivot").alias("v")).distinct()
    links = stored(_verified(pairs, texts, threshold), "links")
    roots = stored(components(links), "roots")
    rest = buckets.filter("more").select("key", "line")
    named = rest.join(roots.withColumnRenamed("id", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    named = stored(named, "named")
    # lines that meet in several bands make the same bucket again: 128 bits of their hashes tell
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "line")).alias("y")]
    open_ = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), *same).filter("a < b")
    open_ = open_.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    named = stored(named.join(open_, "key").select("key", "line", "root"), "open")
    links = links.unionByName(_compared(named, texts, threshold))
    return components(links).withColumnRenamed("id", "line")


def _verdicts(docs, key, text, threshold):
    """(doc, version, line, place, component, kept) of every line; version is the hash of the whole text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    rows = rows.withColumn("version", F.xxhash64("text"))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(_gathered(_dealt(rows, parts).repartitionById(parts, "part")), "lines")
    places = found.filter("key is null").select("line", "doc", "version", "place")
    buckets = found.filter("key is not null").select("key", "line", "pivot", "more")

    # a line that meets none and has no copy stays, and is in none of the tables that follow
    spot = F.struct("doc", "place", "version")
    firsts = places.groupBy("line").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("copies"))
    met = buckets.select("line").union(buckets.select("pivot")).distinct().withColumn("met", F.lit(True))
    firsts = stored(firsts.join(met, "line", "left").filter("met or copies > 1"), "firsts")
    wanted = firsts.filter("met").groupBy(F.col("first.doc").alias("id"), F.col("first.version").alias("version"))
    wanted = wanted.agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "line")).alias("wanted"))
    texts = stored(_texts(rows.join(wanted, ["id", "version"]).select("text", "wanted")), "texts")

    # the first spot of a component is marked at its own line, so that no component is dealt to one task
    firsts = firsts.join(_links(buckets, texts, threshold), "line", "left")
    firsts = stored(firsts.select("line", "first", F.coalesce("root", "line").alias("component")), "classes")
    kept = firsts.groupBy("component").agg(F.min(F.struct("first", "line")).alias("kept")).select(F.col("kept.line").alias("line"), F.col("kept.first").alias("kept"))
    classes = stored(firsts.select("line", "component").join(kept, "line", "left").withColumn("known", F.lit(True)), "kept")
    out = places.join(classes, "line", "left")
    stays = F.when(F.col("known"), F.coalesce(F.col("kept") == spot, F.lit(False))).otherwise(F.lit(True))
    return out.select("doc", "version", "line", "place", F.coalesce("component", "line").alias("component"), stays.alias("kept"))


def line_verdicts(docs, key="doc_id", text="text", threshold=THRESHOLD):
    """key, place (from 0), line (hash), component (smallest line hash) and kept of every line
    that is not blank. Of each component the first line by key and place is kept."""
    out = _verdicts(docs, key, text, threshold)
    return out.select(F.col("doc").alias(key), "place", "line", "component", "kept")


def without_repeated_lines(docs, key="doc_id", text="text", threshold=THRESHOLD, length="n_chars"):
    """docs without the lines that are not kept; a document that loses its last line goes.

    Other columns stay; the length column, if there is one, is the new number of characters.
    """
    gone = _verdicts(docs, key, text, threshold).filter("not kept")
    gone = gone.groupBy(F.col("doc").alias("_key"), F.col("version").alias("_version")).agg(F.collect_set("place").alias("_gone"))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    same = (F.col("_id") == gone["_key"]) & (F.xxhash64("text") == gone["_version"])
    rows = rows.join(gone, same, "left").select("_row", "text", "_gone")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keep, texts = [], []
                for text_, places in zip(part.column("text").to_pylist(), part.column("_gone").to_pylist()):
                    if places and text_:
                        places = set(places)
                        found = [x for i, x in enumerate(text_.split("\n")) if i not in places]
                        keep.append(any(x.strip(" \t\x0b\x0c\r") for x in found))
                        text_ = "\n".join(found)
                    else:
                        keep.append(True)
                    texts.append(text_)
                out = pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])
                yield out.filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())])
    out = rows.mapInArrow(run, schema)
    changed = {text: F.col("_text"), **({length: F.length("_text").cast(docs.schema[length].dataType)} if length in names else {})}
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in names])
