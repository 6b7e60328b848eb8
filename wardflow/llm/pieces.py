"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model file is a parameter. Its pieces come from merges: the neighbouring pair whose
joined piece scores best is joined first, the leftmost of equals. Of all segmentations into
pieces exactly one is what these merges leave, and it is the one in which every two
neighbours would stay apart if they stood alone. That makes a Viterbi search: a state is a
boundary with its last piece, a step to the next piece is allowed if the two stay apart,
and one path survives at each boundary. The ids equal those of the sentencepiece library.

The search keeps a window: the boundaries that a piece can still reach, bounded by the
longest piece, and the backpointers behind them. Whenever all surviving paths meet in one
boundary, the ids up to it are final and leave the window, so its size does not grow with
the text. No piece goes on after a U+2581 that follows another character, so all paths meet
before each; the short chunks between are searched many at a time, one boundary after the
other in numpy, and remembered.

Fixed values of the file format: spaces are U+2581, one is put before a text that is not
empty, a character without a piece becomes its UTF-8 bytes.

Defined results: null and empty texts have no ids; repeated rows are encoded each; an empty
table gives an empty table. Decoding gives the text back, but for U+2581, which becomes a
space.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.words import mix, slices, text_buffer

SPACE = "▁"
#: Chunks that a Python worker remembers; a full table is emptied.
REMEMBERED = 1_000_000
#: Longer chunks are searched alone, by the streaming search, and not remembered.
SHORT = 24
#: Bits of the table of remembered pairs.
ANSWERS = 20
NEVER = 1 << 61
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP = np.array([pow(int(_BASE), i, 2**64) for i in range(SHORT + 1)], np.uint64)
_DOWN = np.array([pow(int(_BASE), -i, 2**64) for i in range(SHORT + 1)], np.uint64)


def default_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Lookup:
    """Open-addressing table from 64-bit keys to numbers, read many at a time."""

    def __init__(self, keys, values, missing):
        self.bits = int(len(keys) * 4).bit_length()
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, missing, np.int64)
        self.missing = missing
        for key, value in zip(keys.tolist(), values):
            at = key >> (64 - self.bits)
            while self.keys[at]:
                at = (at + 1) % size
            self.keys[at], self.values[at] = key, value

    def __call__(self, keys):
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.missing)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there != 0)
            open_, at = open_[go], at[go]
        return out


def _hash_of(points):
    """Hash of the code points of one piece."""
    total = sum(int(p) * int(u) for p, u in zip(points, _UP)) & (2**64 - 1)
    return mix(np.array([total], np.uint64))[0]


class Pieces:
    """Piece table of a model file with the search and the decoder."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, self.ids, self.decoded, ranks = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.decoded.append(piece.replace(SPACE, " ").encode())
                self.ids[piece], ranks[piece] = i, round(-model.get_score(i))
        self.longest = max(map(len, self.ids))
        #: No piece has U+2581 after another character.
        self.chunked = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self._tables(ranks)
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.known, self.apart = {}, {}
        self.asked, self.answers = np.zeros(1 << ANSWERS, np.uint64), np.zeros(1 << ANSWERS, bool)

    def _tables(self, ranks):
        """Rank, left and right part of each piece's last merge, and ranks of joining pairs."""
        n = len(self.decoded)
        self.none = n  # stands for a character without a piece
        self.rank = np.full(n + 1, -1, np.int64)  # -1: a single character, never merged
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        joins, values = [], []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                continue
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    joins.append((a << 32) | b)
                    values.append(ranks[piece])
            parts = self._merged(piece, ranks)
            self.rank[i], self.left[i], self.right[i] = ranks[piece], self.ids[parts[0]], self.ids[parts[1]]
        self.joins = dict(zip(joins, values))
        self.ranks, self.lefts, self.rights = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self.joined = _Lookup(mix(np.array(joins, np.uint64)), values, NEVER)
        pieces = [p for p in self.ids if len(p) <= SHORT]
        hashes = np.array([_hash_of([ord(c) for c in p]) for p in pieces], np.uint64)
        self.piece_at = _Lookup(hashes, [self.ids[p] for p in pieces], -1)

    @staticmethod
    def _merged(piece, ranks):
        """The two parts that the last merge of a piece joins."""
        parts = list(piece)
        while len(parts) > 2:
            pairs = [(ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(pairs)
            if rank == NEVER:
                raise ValueError(f"merges do not make the piece {piece!r}")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart_many(self, first, second):
        """stay_apart through a table of earlier answers, one for each slot."""
        pairs = mix((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))
        at = (pairs >> np.uint64(64 - ANSWERS)).astype(np.int64)
        new = np.flatnonzero(self.asked[at] != pairs)
        out = self.answers[at]
        if len(new):
            out[new] = self.stay_apart(first[new], second[new])
            self.answers[at[new]] = out[new]
            self.asked[at[new]] = pairs[new]
        return out

    def stay_apart(self, first, second):
        """Whether merges leave two neighbouring pieces as they are, for arrays of ids.

        Takes the merges of both back, last one first. A pair over the border that joins
        before the merge just taken back would have joined first; of equal ranks the left
        one goes first. Ranks are doubled to hold that order.
        """
        out = np.ones(len(first), bool)
        lanes, a, b = np.arange(len(first)), first.copy(), second.copy()
        limit = np.full(len(first), NEVER)
        while len(lanes):
            over = self.joined(mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)))
            joins = 2 * over < limit
            out[lanes[joins]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~joins & (np.maximum(rank_a, rank_b) >= 0)
            lanes, a, b, rank_a, rank_b = lanes[go], a[go], b[go], rank_a[go], rank_b[go]
            in_a = rank_a > rank_b
            limit = np.where(in_a, 2 * rank_a, 2 * rank_b + 1)
            a, b = np.where(in_a, self.right[a], a), np.where(in_a, b, self.left[b])
        return out

    def _apart(self, a, b):
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) >= REMEMBERED // 4:
                self.apart.clear()
            found = self.apart[a, b] = self._stays_apart(a, b)
        return found

    def _stays_apart(self, a, b):
        """stay_apart for one pair."""
        limit, rank, left, right = NEVER, self.ranks, self.lefts, self.rights
        while True:
            if 2 * self.joins.get((a << 32) | b, NEVER) < limit:
                return False
            rank_a, rank_b = rank[a], rank[b]
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                a, limit = right[a], 2 * rank_a
            else:
                b, limit = left[b], 2 * rank_b + 1

    def search(self, text):
        """Yields lists of ids as they become final. text has its spaces replaced."""
        last, begin = {0: None}, {}  # of each boundary in the window: last piece, where it begins
        done, n = 0, len(text)
        for at in range(n):
            if at - done >= 2 * self.longest:
                meet = self._meeting(begin, {at, *(k for k in begin if k > at)}, done)
                if meet > done:
                    yield self._path(text, begin, done, meet)
                    begin = {k: v for k, v in begin.items() if k > meet}
                    done = meet
            before = last.pop(at)
            for to in range(at + 1, min(at + self.longest, n) + 1):
                piece = text[at:to]
                if piece not in self.starts:
                    break
                i = self.ids.get(piece)
                if i is not None and (before is None or self._apart(before, i)):
                    last[to], begin[to] = i, at
            if text[at] not in self.ids:
                last[at + 1], begin[at + 1] = self.none, at
        if n > done:
            yield self._path(text, begin, done, n)

    @staticmethod
    def _meeting(begin, paths, done):
        """Last boundary that every surviving path goes through."""
        while len(paths) > 1:
            last = max(paths)
            if last <= done:
                return done
            paths.discard(last)
            paths.add(begin[last])
        return paths.pop()

    def _path(self, text, begin, done, to):
        cuts = [to]
        while cuts[-1] > done:
            cuts.append(begin[cuts[-1]])
        cuts.reverse()
        found = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.ids.get(text[a:b])
            found += [i] if i is not None else [self.byte_ids[x] for x in text[a:b].encode()]
        return found

    def search_many(self, chunks):
        """Ids of each of many short chunks, as little-endian 32-bit bytes."""
        chunks = sorted(chunks, key=len, reverse=True)
        lengths = np.array([len(c) for c in chunks])
        width, m = int(lengths[0]), len(chunks)
        points = np.array(chunks, f"<U{width}").view(np.uint32).reshape(m, width).astype(np.uint64)
        sums = np.zeros((width + 1, m), np.uint64)
        np.cumsum((points * _UP[:width]).T, axis=0, out=sums[1:])
        last, size = np.full((width + 1, m), self.none, np.int64), np.zeros((width + 1, m), np.int8)
        for at in range(width):
            for k in range(1, min(self.longest, width - at) + 1):
                live = int(np.searchsorted(-lengths, -(at + k), "right"))
                piece = self.piece_at(mix((sums[at + k, :live] - sums[at, :live]) * _DOWN[at]))
                lanes = np.flatnonzero(piece >= 0)
                if at and len(lanes):
                    lanes = lanes[self._apart_many(last[at, lanes], piece[lanes])]
                last[at + k, lanes], size[at + k, lanes] = piece[lanes], k
                if k == 1:
                    lost = np.flatnonzero(piece < 0)
                    last[at + 1, lost], size[at + 1, lost] = self.none, 1
        ends, lanes, found, lane_of = lengths.copy(), np.arange(m), [], []
        while len(lanes):
            found.append(last[ends[lanes], lanes])
            lane_of.append(lanes)
            ends[lanes] -= size[ends[lanes], lanes]
            lanes = lanes[ends[lanes] > 0]
        found, lane_of = np.concatenate(found[::-1]), np.concatenate(lane_of[::-1])
        order = np.argsort(lane_of, kind="stable")
        flat, cuts = found[order].astype("<i4").tobytes(), np.searchsorted(lane_of[order], np.arange(m + 1)) * 4
        out = {c: flat[a:b] for c, a, b in zip(chunks, cuts.tolist(), cuts[1:].tolist())}
        for i in np.unique(lane_of[found == self.none]):
            begin, to = {}, len(chunks[i])
            while to > 0:
                begin[to], to = to - int(size[to, i]), to - int(size[to, i])
            out[chunks[i]] = np.array(self._path(chunks[i], begin, 0, len(chunks[i])), "<i4").tobytes()
        return out

    def _alone(self, chunk):
        return np.array([i for part in self.search(chunk) for i in part], "<i4").tobytes()

    def _chunks(self, text):
        """Chunks of a text that is not empty; a word stands for U+2581 and the word."""
        if not self.chunked:
            return [SPACE + text.replace(" ", SPACE)]
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = SPACE + text.replace(" ", SPACE)
            chunks = re.split(f"(?<=[^{SPACE}])(?={SPACE})", marked)
            return [c[1:] if len(c) > 1 and c[1] != SPACE else c for c in chunks]
        return text.split(" ")

    def encode_all(self, texts):
        """Ids of each text as little-endian 32-bit bytes."""
        split = [self._chunks(t) if t else [] for t in texts]
        known = self.known
        seen = set().union(*split)
        if len(known) + len(seen) > REMEMBERED:
            known.clear()
        new = seen.difference(known)
        whole = {w: (w if w[0] == SPACE else SPACE + w) if self.chunked else w for w in new}
        short = [c for c in whole.values() if len(c) <= SHORT]
        found = self.search_many(short) if short else {}
        for w, c in whole.items():
            known[w] = found[c] if len(c) <= SHORT else self._alone(c)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w, c in whole.items():
            if len(c) > SHORT:
                del known[w]
        return out

    def decode(self, ids):
        """Text of a list of ids."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED = {}


def _pieces(path):
    """One piece table for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _moved(docs, names):
    """docs with columns of these names renamed to input_<name>, repeated until it is free."""
    for name in names:
        if name in docs.columns:
            free = f"input_{name}"
            while free in docs.columns:
                free = f"input_{free}"
            docs = docs.withColumnRenamed(name, free)
    return docs


def encode(docs, text="text", ids="ids", path=None, check=None):
    """docs with the ids of its text column; check names a boolean column: decoding the ids
    gives the text back. Columns of docs that have these names stay as input_<name>."""
    path = path or default_model()
    docs = _moved(docs, [c for c in (ids, check) if c])
    names = docs.columns
    fields = [docs.schema[c] for c in names] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(check, T.BooleanType())] if check else []
    kind = pa.list_(pa.field("element", pa.int32(), False))

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_buffer(part.column(text))
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
                found = pieces.encode_all(texts)
                ends = np.cumsum([0] + [len(f) // 4 for f in found]).astype(np.int32)
                values = np.frombuffer(b"".join(found), "<i4")
                arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values), type=kind)]
                if check:
                    same = [pieces.decode(values[a:b].tolist()) == t.replace(SPACE, " ") for a, b, t in zip(ends, ends[1:], texts)]
                    arrays.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select(*names).mapInArrow(run, T.StructType(fields))


def decode(table, ids="ids", text="text", path=None):
    """table with the text of its ids column; null ids give a null text."""
    path = path or default_model()
    names = [c for c in table.columns if c != text]
    schema = T.StructType([table.schema[c] for c in names] + [T.StructField(text, T.StringType())])

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            texts = [None if not row.is_valid else pieces.decode(row.values.to_pylist()) for row in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return table.select(*names).mapInArrow(run, schema)


def encoded_documents(docs, key="doc_id", text="text", path=None):
    """key, n_ids, ids and round_trip of every document."""
    out = encode(docs.select(key, text), text, "ids", path, "round_trip")
    return out.select(key, F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
