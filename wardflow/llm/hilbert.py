"""Sharding along a Hilbert curve: quantised metadata, curve index, equal runs.

Only DataFrame functions. Rows close on the curve are close in every dimension, so a shard
covers a small box of metadata and readers can skip shards by the ranges in `shard_boxes`.

Defined results: a null value of a dimension is cell 0; equal cells are ordered by the key
columns; repeated rows are placed one by one; with fewer rows than shards some shards stay
empty; an empty table gives an empty table.
"""

from functools import partial

from pyspark.sql import functions as F

from wardflow.llm.stages import let, ranked, stored


def number_cells(df, column, bits):
    """Cell of a numeric column between approximate quantiles; 2**bits - 1 borders."""
    cells = 1 << bits
    shares = [i / cells for i in range(1, cells)]
    borders = df.agg(F.percentile_approx(column, shares, 20 * cells)).first()[0] or []
    borders = sorted(set(borders))
    if not borders:
        return F.lit(0)
    count = F.aggregate(F.array(*[F.lit(b) for b in borders]), F.lit(0), lambda n, b: n + (F.col(column) > b).cast("int"))
    return F.when(F.col(column).isNull(), 0).otherwise(count)


def text_cells(df, column, bits, cell):
    """df with the cell of a text column: position among its distinct values, whole strings."""
    values = ranked(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_pos")
    values = stored(values, "values")
    n = max(values.count(), 1)
    table = values.select(column, F.floor(F.col("_pos") * (1 << bits) / n).cast("int").alias(cell))
    return df.join(table, column, "left").withColumn(cell, F.coalesce(cell, F.lit(0)))


def curve_index(cells, bits):
    """Index on the Hilbert curve of cells (integer columns of `bits` bits each).

    Undoes the rotations from the highest bit down, Gray-codes the axes and interleaves
    their bits (Skilling, "Programming the Hilbert curve", 2004).
    """
    n = len(cells)
    names = [f"x{i}" for i in range(n)]

    def state(x):
        return F.struct(*[v.cast("int").alias(k) for k, v in zip(names, x)])

    def turn(i, q, s):
        x = [s[k] for k in names]
        low = F.lit(q - 1)
        on = x[i].bitwiseAND(F.lit(q)) != 0
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        first = F.when(on, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
        if i == 0:
            return state([F.when(on, first).otherwise(x[0]), *x[1:]])
        x[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return state([first, *x[1:]])

    def steps(column):
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            for i in range(n):
                column = let(column, partial(turn, i, q))
        return column

    def gray(s):
        x = [s[names[0]]]
        for k in names[1:]:
            x.append(s[k].bitwiseXOR(x[-1]))
        flip = F.lit(0)
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            flip = flip.bitwiseXOR(F.when(x[-1].bitwiseAND(F.lit(q)) != 0, q - 1).otherwise(0))
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index * 2 + F.shiftright(v.bitwiseXOR(flip), b).bitwiseAND(F.lit(1))
        return index

    return let(steps(state(cells)), gray)


def hilbert_shards(table, numbers, texts, key, shards, bits=5):
    """table (stored, narrow) with shard and slot by equal runs of rows along the curve.

    numbers and texts name the dimensions, key the columns that order equal cells. Shard
    sizes differ by one row at most.
    """
    n = table.count()
    cells = [number_cells(table, c, bits) for c in numbers]
    placed = table.select("*", *[c.alias(f"_n{i}") for i, c in enumerate(cells)])
    for i, c in enumerate(texts):
        placed = text_cells(placed, c, bits, f"_t{i}")
    names = [f"_t{i}" for i in range(len(texts))] + [f"_n{i}" for i in range(len(numbers))]
    placed = placed.withColumn("curve", curve_index([F.col(c) for c in names], bits)).drop(*names)
    placed = ranked(placed, ["curve", *key], "_rank")
    shard = F.expr(f"(_rank * {shards}) div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - start).cast("long")).drop("_rank")


def document_shards(docs, shards, bits=5, key="doc_id", text="text", texts=("source", "lang")):
    """key, size, text_crc32, law, shard, slot, grown_shard and curve of every document.

    Dimensions: the text columns, the size and the key. size is the UTF-8 length (null: 0)
    plus 16, text_crc32 the checksum of the UTF-8 bytes (null: of none).
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    check = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")
    narrow = docs.select(F.col(key), size.alias("size"), check.alias("text_crc32"), *[F.col(c) for c in texts])
    placed = hilbert_shards(stored(narrow, "sizes"), ["size", key], list(texts), [key, "text_crc32"], shards, bits)
    return placed.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *texts
    )


def shard_boxes(placed, columns):
    """Smallest and largest value of each column in each shard, for skipping files."""
    sides = [side(c).alias(f"{name}_{c}") for c in columns for name, side in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *sides)


def write_shards(docs, placed, path, key="doc_id"):
    """Write each shard of docs into its own folder, in slot order; key must be unique.

    Columns shard and slot of docs are kept as input_shard and input_slot.
    """
    for name in ("shard", "slot"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"input_{name}")
    rows = docs.join(placed.select(key, "shard", "slot"), key)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
