"""Tokens of two tokenizers aligned by pointer jumping.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts the
space itself, so both cover the same bytes. Every token points to the token of the other
side that covers its last byte, the farthest-right one it overlaps; where both end at one
byte the token of A points to itself. Doubling the pointers of all tokens of a slice at once
converges to the terminal token of each component, whose number labels the group.

Ids of a group are linked, each of A with each of B. The documents that hold a linked id
pair are counted in each block, summed over the corpus by a shuffle on the pair, and joined
back to the blocks (see blocks). Links of equal ids in a group are counted, not listed.

Fixed values: byte-level entries stand for bytes by the printable characters of ISO 8859-1
first, then by code points from 256; U+2581 is a space; <0xHH> is the byte HH.

Defined results: null and empty texts, and texts whose tokens do not give their bytes back
(such as with U+2581), have no tokens, zeros and an empty digest; repeated rows are documents
each; a null key stays; an empty table gives an empty table; columns other than key and text
are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm.blocks import block_number, numbers, reassembled, squeezed, things
from wardflow.llm.chunks import ByteLevel, Memory, chunk_starts, distinct, listed, strung
from wardflow.llm.stages import stored
from wardflow.llm.words import slices, text_buffer

#: Bytes of text of a block, one document at least.
BLOCK = 1 << 21
#: Groups with more links than this are reduced to different ids before their links are made.
LARGE = 256
SPACE = "▁"


def default_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character():
    """{character: byte} of byte-level entries."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of chunks, bytes of ids, and the ids as text."""

    def __init__(self, token_bytes, encode):
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.memory = Memory(encode, self.gives_back)
        self.names = [str(i).encode() for i in range(len(token_bytes))]

    def gives_back(self, chunks, ids, sizes):
        """Whether the bytes of the ids of a chunk are the chunk."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        given = strung(ids, self.flat, self.sizes)[0].tobytes()
        return np.fromiter((given[a:b] == c for a, b, c in zip(ends, ends[1:], chunks)), bool, len(chunks))

    def ids(self, chunks):
        """(ids of the chunks, how many each has, whether each gives its bytes back)."""
        values, sizes, right = self.memory(chunks)
        return values.astype(np.int64), sizes, right


def byte_level(path):
    tokenizer, code = ByteLevel(path, special=False), byte_of_character()
    return Side([bytes(code[c] for c in e) if all(c in code for c in e) else e.encode() for e in tokenizer.entries], tokenizer)


def piece_level(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token_bytes = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        token_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
    return Side(token_bytes, lambda chunks: listed(model.encode([c[1:].decode() for c in chunks], num_threads=1)))


_LOADED = {}


def _sides(paths):
    if paths not in _LOADED:
        _LOADED[paths] = byte_level(paths[0]), piece_level(paths[1])
    return _LOADED[paths]


def groups(a_ends, b_ends):
    """(group of each token of A, group of each token of B), numbered from the left.

    a_ends, b_ends: where the tokens end; both sides end at the same last byte.
    """
    n = len(a_ends)
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    terminal = b_ends[over_a] == a_ends if n else np.zeros(0, bool)
    to = np.concatenate([np.where(terminal, np.arange(n), n + over_a), over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    number = np.cumsum(terminal) - 1
    return number[to[:n]], number[to[n:]]


def _links(a, b, a_group, b_group, n_groups):
    """(group, id of A, id of B, links) with every linked id pair of a group, some repeated."""
    m, k = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    a_first, b_first = np.cumsum(m) - m, np.cumsum(k) - k
    large = np.flatnonzero(m * k > LARGE)
    found = []
    for g in large:
        x, nx = np.unique(a[a_first[g] : a_first[g] + m[g]], return_counts=True)
        y, ny = np.unique(b[b_first[g] : b_first[g] + k[g]], return_counts=True)
        found.append((np.full(len(x) * len(y), g), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
    small = np.ones(n_groups, bool)
    small[large] = False
    mine = np.flatnonzero(small[a_group])  # tokens of A; each meets all tokens of B of its group
    g = a_group[mine]
    times = k[g]
    row = np.repeat(np.arange(len(mine)), times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + b_first[g][row]
    found.append((g[row], a[mine][row], b[place], np.ones(len(row), np.int64)))
    return [np.concatenate(c) for c in zip(*found)]


def _with_space(data, offsets):
    """Texts that are not empty with a space before them."""
    filled = offsets[:-1] < offsets[1:]
    out = np.insert(data, offsets[:-1][filled], 32)
    return out, offsets + np.concatenate([[0], np.cumsum(filled)])


NAMES = ("n_a", "n_b", "n_groups", "n_links")


def _lines(sides, ids, of_a, of_b, chunk_of):
    """Groups of each chunk as text, each followed by a semicolon; of_a, of_b: groups of the
    tokens; chunk_of: chunk of each group."""
    n_groups, texts = len(chunk_of), []
    for side, tokens, of in zip(sides, ids, (of_a, of_b)):
        names, ends = [side.names[i] for i in tokens.tolist()], np.cumsum(np.bincount(of, minlength=n_groups)).tolist()
        texts.append([b",".join(names[a:b]) if b - a > 1 else names[a] for a, b in zip([0, *ends], ends)])
    whole = [a + b"|" + b + b";" for a, b in zip(*texts)]
    ends = np.searchsorted(chunk_of, np.arange(1, (chunk_of[-1] if n_groups else -1) + 2)).tolist()
    return [b"".join(whole[a:b]) for a, b in zip([0, *ends], ends)]


def _aligned(part, sides):
    """Counts of each text, its groups as a digest, and the linked id pairs.

    Tokens of both sides end at the borders of chunks, so no group goes over one, and the
    different chunks of the slice are aligned, each once.
    """
    data, offsets = _with_space(*text_buffer(part.column("text")))
    n = part.num_rows
    starts = chunk_starts(data, offsets)
    of, chunks = distinct(data, starts)
    text, m = np.searchsorted(offsets, starts, "right") - 1, len(chunks)
    found = [side.ids(chunks) for side in sides]
    right = found[0][2] & found[1][2]
    bad = np.zeros(n, bool)
    bad[text[~right[of]]] = True
    stays = ~bad[text]
    of, text = of[stays], text[stays]

    ids, rows, ends = [], [], []
    for side, (tokens, lengths, _) in zip(sides, found):
        chunk = np.repeat(np.arange(m), lengths)
        keep = right[chunk]
        ids.append(tokens[keep])
        rows.append(chunk[keep])
        ends.append(np.cumsum(side.sizes[ids[-1]]))
    of_a, of_b = groups(*ends)
    chunk_of = rows[0][np.flatnonzero(np.diff(of_a, prepend=-1))]  # chunk of each group
    group, x, y, times = _links(*ids, of_a, of_b, len(chunk_of))
    of_link = chunk_of[group]
    sizes = [np.bincount(r, minlength=m) for r in (*rows, chunk_of)] + [np.bincount(of_link, times, m).astype(np.int64)]
    counts = [np.bincount(text, s[of], n).astype(np.int64) for s in sizes]

    lines, cuts = _lines(sides, ids, of_a, of_b, chunk_of), np.searchsorted(text, np.arange(n + 1)).tolist()
    lines += [b""] * (m - len(lines))
    order = of.tolist()
    digest = [hashlib.sha256(b"".join([lines[i] for i in order[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(cuts, cuts[1:])]

    pairs, code = np.unique(x << 32 | y, return_inverse=True)
    by_chunk = np.argsort(of_link, kind="stable")
    places, links = strung(of, by_chunk, np.bincount(of_link, minlength=m))
    width = max(len(pairs), 1)
    held, at = np.unique(np.repeat(text, links) * width + code[places], return_inverse=True)
    times = np.bincount(at, times[places], len(held)).astype(np.int64)
    return counts, digest, pairs, held // width, held % width, times


def blocks_of(docs, paths, size=BLOCK):
    """One row for each slice of docs (key, text): counts and digests of its texts, the
    different id pairs with the number of its texts that hold them, and what each text holds."""
    names = ["block", "keys", *NAMES, "digests", "held", "codes", "times", "pairs"]
    schema = "block long, keys array<long>, " + ", ".join(f"{n} array<long>" for n in NAMES)
    schema += ", digests array<string>, held array<long>, codes binary, times binary, pairs array<struct<pair: long, docs: long>>"

    def run(batches):
        sides, i = _sides(paths), 0
        for batch in batches:
            for part in slices(batch, size=size):
                counts, digest, pairs, row, code, times = _aligned(part, sides)
                docs_of = np.bincount(code, minlength=len(pairs))
                items = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(docs_of, pa.int64())], names=["pair", "docs"])
                arrays = [pa.array([block_number(i)], pa.int64()), pa.array([part.column("key").to_pylist()], pa.list_(pa.int64()))]
                arrays += [pa.array([c], pa.list_(pa.int64())) for c in counts]
                arrays += [pa.array([digest], pa.list_(pa.string())), pa.array([np.bincount(row, minlength=part.num_rows)], pa.list_(pa.int64()))]
                arrays += [pa.array([squeezed(code)], pa.binary()), pa.array([squeezed(times)], pa.binary())]
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items))
                i += 1
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)


def _build(row, answers):
    codes, times, held = numbers(row["codes"]), numbers(row["times"]), np.array(row["held"], np.int64)
    ends = np.concatenate([[0], np.cumsum(held)])

    def sums(weights):
        total = np.concatenate([[0], np.cumsum(times * weights[codes])]) if len(codes) else np.zeros(1, np.int64)
        return pa.array(np.diff(total[ends]), pa.int64())

    best, count = (answers.column(c).to_numpy().astype(np.int64) for c in ("best", "count"))
    columns = [pa.array(row["keys"], pa.int64()), *(pa.array(row[n], pa.int64()) for n in NAMES)]
    columns += [sums(best), sums(count), pa.array(row["digests"], pa.string())]
    return pa.table(columns, names=["key", *NAMES, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks):
    """(pair, count, best): documents that hold a linked pair, and whether no other pair of
    its id of A is in more. A pair is the id of A times 2**32 plus the id of B."""
    held = blocks.select(F.explode("pairs").alias("p")).select("p.pair", "p.docs")
    counts = stored(held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))


def align(docs, key="doc_id", text="text", paths=None, size=BLOCK):
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    paths = tuple(paths or default_paths())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    blocks = stored(blocks_of(rows, paths, size), "blocks")
    counts = stored(pair_counts(blocks), "counts")
    exploded = things(blocks, "pairs", "p").select("block", "code", F.col("p.pair").alias("pair"))
    answers = exploded.join(counts, "pair").select("block", "code", "count", "best")
    schema = "key long, " + ", ".join(f"{n} long" for n in NAMES) + ", n_best long, count_sum long, groups_sha256 string"
    out = reassembled(blocks.drop("pairs"), answers, _build, schema)
    return out.withColumnRenamed("key", key)
