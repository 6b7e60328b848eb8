"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of all word shingles. Equal
fingerprints are one row from then on. Bit i gets a nonzero vector of r + 1 bits, and mask v
keeps the bits whose vector has an odd product with v (Pagh, "CoveringLSH", 2018). At most r
differing bits give r equations in r + 1 unknowns, so some v <> 0 keeps none of them: every
pair within the radius meets under one of the 2**(r + 1) - 1 masks, for certain.

Rows that meet under a mask form a bucket. A bucket is compared in one task only if it is
small; a larger one is covered again by masks over its free bits. Fingerprints are
distinct, so a bucket with f free bits holds 2**f rows at most, and the cutting ends.

Defined results: null and empty texts and texts without words have fingerprint zero and
link like any other; fewer words than a shingle give one shingle; repeated rows and ties
fall into one class; a row without an id gets no component and is never removed; an empty
table gives an empty table. Other columns of the documents are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from wardflow.llm.components import components
from wardflow.llm.stages import repeated_keys, stored
from wardflow.llm.words import slices, text_buffer

BITS = 64
#: Rows of a bucket that one task compares.
BUCKET = 2048
SHINGLES_AT_ONCE = 1 << 16
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def _set_bits(values):
    """How many of the 64-bit values have each bit."""
    lanes = np.array(values, "<u8").view(np.uint8).reshape(-1, 8) + _LANES
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE).ravel()


def fingerprint(text, n=3, seed=42):
    """Fingerprint of UTF-8 bytes as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    counts, total, digest = np.zeros(BITS, np.int64), len(words) - n + 1, xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = words[at : at + SHINGLES_AT_ONCE + n - 1]
        counts += _set_bits([digest(b" ".join(s), seed) for s in zip(*[part[i:] for i in range(n)])])
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs, key="doc_id", text="text", n=3, seed=42):
    """(id, fp, version): fingerprints as signed longs, and a hash of the whole text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                prints = [fingerprint(data[a:b].tobytes(), n, seed) for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [part.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64)), part.column("version")]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "version"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    return rows.mapInArrow(run, "id long, fp long, version long")


def covering_masks(free, radius):
    """Masks over the bits of `free`; any `radius` bits are absent from one of them."""
    size = 1 << (radius + 1)
    places = [i for i in range(BITS) if free >> i & 1]
    vectors = {place: i % (size - 1) + 1 for i, place in enumerate(places)}
    return [sum(1 << p for p, w in vectors.items() if (v & w).bit_count() % 2) for v in range(1, size)]


def _signed(x):
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _stars(batches, radius):
    """Links (u, v) that join what is within the radius inside each bucket."""
    for batch in batches:
        u, v = [], []
        for bucket in batch.column("rows"):
            ids = bucket.values.field("id").to_numpy(zero_copy_only=False)
            prints = bucket.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(ids)
            ids, prints = ids[order], prints[order]
            left = np.arange(len(ids))
            while len(left) > 1:
                root, left, queue = left[0], left[1:], [left[0]]
                while queue and len(left):
                    near = np.bitwise_count(prints[left] ^ prints[queue.pop()]) <= radius
                    found, left = left[near], left[~near]
                    queue.extend(found.tolist())
                    u.extend(ids[found].tolist())
                    v.extend([ids[root]] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def links(classes, radius=3, bucket=BUCKET):
    """Links (u, v) between classes (id, fp), fp distinct, whose components are those of all
    pairs within the radius. bucket bounds the rows that one task compares at once."""
    spark = classes.sparkSession
    rows, fixed, found = stored(classes.withColumn("fixed", F.lit(0).cast("long")), "classes"), {0}, []
    while True:
        children = [(_signed(p), _signed(p | m)) for p in sorted(fixed) for m in covering_masks(~p & (1 << BITS) - 1, radius)]
        table = F.broadcast(spark.createDataFrame(children, "fixed long, mask long"))  # 15 rows a parent, by the radius alone
        masked = rows.join(table, "fixed").select("id", "fp", F.col("mask").alias("fixed"))
        masked = masked.withColumn("key", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))))
        shared = stored(repeated_keys(stored(masked, "masked"), "key", ["id"]), "buckets")
        sizes = shared.groupBy("key").count()
        small = shared.join(sizes.filter((F.col("count") > 1) & (F.col("count") <= bucket)), "key", "left_semi")
        gathered = small.groupBy("key").agg(F.collect_list(F.struct("id", "fp")).alias("rows")).select("rows")
        found.append(gathered.mapInArrow(lambda batches: _stars(batches, radius), "u long, v long"))
        rows = stored(shared.join(sizes.filter(F.col("count") > bucket), "key", "left_semi").select("id", "fp", "fixed"), "hot")
        fixed = {p % (1 << BITS) for (p,) in rows.select("fixed").distinct().collect()}
        if not fixed:
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs, key="doc_id", text="text", n=3, seed=42, radius=3, bucket=BUCKET):
    """key, fingerprint (16 hex digits) and component_id, the smallest id that is reachable."""
    prints = stored(fingerprints(docs, key, text, n, seed).drop("version"), "prints")
    classes = stored(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "classes")
    roots = components(links(classes, radius, bucket))
    labelled = classes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = prints.join(labelled, "fp", "left")
    return out.select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs, key="doc_id", text="text", n=3, seed=42, radius=3, bucket=BUCKET):
    """One row of each component, that with the smallest id; rows without an id stay.

    Components are of fingerprints, not of ids, so rows of one id with different texts stay
    or go each by its own text. Of rows with one id and text that with the smallest hash of
    its columns stays (maps not counted). Columns may have any names.
    """
    prints = stored(fingerprints(docs, key, text, n, seed).filter("id is not null"), "prints")
    roots = components(links(stored(prints.select("fp").distinct().withColumn("id", F.col("fp")), "classes"), radius, bucket))
    labelled = prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = labelled.groupBy("root").agg(F.min(F.struct("id", "version")).alias("kept")).select("kept.*").distinct()
    whole = F.struct(*[docs[c] for c in docs.columns])
    plain = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    named = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("version"), whole.alias("row"), F.xxhash64(*plain).alias("order"))
    rows = named.join(kept, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.min_by("row", "order").alias("row"))
    return rows.select("row.*").unionByName(docs.filter(docs[key].isNull()))
