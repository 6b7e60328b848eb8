"""Approximate nearest neighbours: inverted lists read by an adaptive dimension scan.

Vectors belong to the list of their nearest centroid, fitted on a bounded sample. A query
probes the lists nearest to it. In a list, rotated vectors lie in column blocks. After each
block the partial distance of a candidate, scaled to all dimensions, is tested against the
k-th distance so far: a candidate whose partial sum is above (d / D) (1 + e / sqrt d)^2 of
that distance is given up (Gao and Long, "High-Dimensional Approximate Nearest Neighbor
Search: with Reliable and Efficient Distance Comparison Operations", 2023). Survivors get
the exact distance of the original vectors in double precision.

A list is cut into chunks of bounded size by a hash of the id, and the queries of a list
into blocks, so no task holds a whole list or all its queries, however hot.

Defined results: vectors that are null, zero, empty or hold a null or a number that is not
finite take no part, nor do rows without an id or with another length than most (of equally
frequent lengths the smallest). Ties go to the smaller id. Rows with equal ids are one
candidate, as near as the nearest of them, and never one of their own query. A query has
fewer than k results only where it has fewer candidates. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.stages import stored

SAMPLE = 32_768
MAX_LISTS = 1024
#: Rows of a list, and queries of a list, that meet in one task call.
CHUNK = 4096
QUERIES = 1024
BLOCKS = (8, 8, 16)
EPSILON = 2.1
#: Candidates that are read in full to get the first k-th distance.
FIRST = 32


def _matrix(column, dims, kind="<f4"):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _nearest(x, centroids, count=1):
    """Numbers of the nearest centroids of each row, nearest first."""
    distance = (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    if count == 1:
        return distance.argmin(1)[:, None]
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def usable(table, key, vector):
    """(id, x) of the vectors that take part, and their dimensions (0: there are none). x is
    of floats if the column is, else of doubles."""
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("x")).filter("id is not null")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False)))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = most["d"] if most else 0
    return rows.filter(F.size("x") == dims), dims


def _packed(rows, dims, kind):
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind)
            packed = [r.tobytes() for r in x.reshape(-1, dims)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "x"])

    return rows.mapInArrow(run, "id long, x binary")


def fit_centroids(vectors, dims, lists, k, recall, rounds=10, kind="<f4"):
    """(centroids, probes): k-means on at most SAMPLE vectors, those whose hashed ids come
    first, in one task, and the lists to probe to meet this share of the k nearest there."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    def run(batches):
        parts = [_matrix(b.column("x"), dims, kind) for b in batches if b.num_rows]
        if not parts:
            return
        x = np.concatenate(parts)
        x = x[np.lexsort(x.T)]
        pick = np.random.default_rng(0).permutation(len(x))
        centroids = x[pick[:lists]].astype(np.float64)
        for _ in range(rounds):
            of = np.concatenate([_nearest(x[a : a + 4096], centroids)[:, 0] for a in range(0, len(x), 4096)])
            sums = np.zeros_like(centroids)
            np.add.at(sums, of, x)
            n = np.bincount(of, minlength=len(centroids))
            centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        centroids = centroids.astype("<f4")
        deep = _ranks_of_neighbours(x, centroids, k)
        probes = int(np.quantile(deep, recall, method="higher")) + 1 if len(deep) else len(centroids)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in centroids], pa.binary()), pa.array([probes] * len(centroids))], names=["c", "probes"])

    found = sample.repartition(1).mapInArrow(run, "c binary, probes long").toArrow()
    return _matrix(found.column("c"), dims).copy(), found.column("probes")[0].as_py()


def _ranks_of_neighbours(x, centroids, k, queries=256):
    """How many nearer lists stand before the list of a true neighbour, within the sample."""
    of, out = _nearest(x, centroids)[:, 0], []
    for i in range(0, len(x), max(1, len(x) // queries)):
        distance = ((x - x[i]) ** 2).sum(1)
        distance[i] = np.inf
        near = np.argpartition(distance, min(k, len(x) - 1))[:k]
        place = np.empty(len(centroids), np.int64)
        place[_nearest(x[i : i + 1], centroids, len(centroids))[0]] = np.arange(len(centroids))
        out.append(place[of[near[np.isfinite(distance[near])]]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def rotation(dims):
    """A random rotation that every task makes for itself."""
    q, r = np.linalg.qr(np.random.default_rng(1).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _borders(dims):
    ends = np.cumsum(BLOCKS)
    return [0, *[int(e) for e in ends if e < dims], dims]


def scan(ids, x, turned, own, q, q_turned, k, epsilon=EPSILON):
    """(ids, distances) of the k nearest rows to one query; turned: column blocks of rotated rows."""
    dims = len(q)
    rows = np.flatnonzero(ids != own)
    # what rounding may add to a distance of the turned vectors
    slack = 1e-12 + dims * (1e-14 * max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0))) ** 2

    def exact(at):
        return np.sqrt(((x[at].astype(np.float64) - q.astype(np.float64)) ** 2).sum(1))

    def best(at, distance):
        order = np.lexsort((ids[at], distance))
        _, once = np.unique(ids[at][order], return_index=True)
        order = order[np.sort(once)[:k]]
        return at[order], distance[order]

    top, reach = best(rows[:FIRST], exact(rows[:FIRST]))
    left = rows[FIRST:]
    if len(top) == k and len(left):
        limit, partial, seen = reach[-1] ** 2 * (1 + 1e-6) + 1e-30, np.zeros(len(left)), 0
        for block, a, b in turned:
            partial = partial + ((block[:, left] - q_turned[a:b, None]) ** 2).sum(0)
            seen = b
            bound = limit * seen / dims * (1 + epsilon / np.sqrt(seen)) ** 2 + slack if seen < dims else limit * (1 + 1e-4) + slack
            stays = partial <= bound
            left, partial = left[stays], partial[stays]
    top, reach = best(np.concatenate([top, left]), np.concatenate([reach, exact(left)]))
    return ids[top], reach


def search(table, queries, k, key="vec_id", vector="embedding", lists=None, probes=None, recall=0.97):
    """query_id, rank, vec_id and score: the k nearest rows found for every query id.

    queries: a condition on `id` that picks the query rows. lists: a quarter of the root of
    the rows, at most MAX_LISTS. probes: lists that a query reads, more where they hold too few
    rows; if not given, as many as reach the recall within the sample.
    """
    spark = table.sparkSession
    rows, dims = usable(table, key, vector)
    schema = "query_id long, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if rows.schema["x"].dataType.simpleString() == "array<float>" else "<f8"
    vectors = stored(_packed(rows, dims, kind), "vectors")
    n = vectors.count()
    lists = min(lists or max(1, round(n**0.5 / 4)), MAX_LISTS)
    centroids, needed = fit_centroids(vectors, dims, lists, k, recall, kind=kind)
    lists = len(centroids)
    probes = min(probes or needed, lists)
    shared = spark.sparkContext.broadcast(centroids)  # MAX_LISTS rows at most

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                of = _nearest(_matrix(batch.column("x"), dims, kind), shared.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], names=["id", "x", "list"])

    placed = stored(vectors.mapInArrow(assign, "id long, x binary, list int"), "lists")
    sizes = np.zeros(lists, np.int64)
    for row in placed.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = _nearest(_matrix(batch.column("x"), dims, kind), shared.value, lists)
            enough = (np.cumsum(sizes[order], axis=1) < 4 * (k + 1)).sum(1) + 1
            count = np.minimum(np.maximum(enough, probes), lists)
            at = np.repeat(np.arange(batch.num_rows), count)
            of = np.concatenate([o[:c] for o, c in zip(order, count)])
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of, pa.int32())], names=["id", "x", "list"])

    asked = stored(vectors.filter(queries).mapInArrow(probe, "id long, x binary, list int"), "probes")
    cuts = asked.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERIES).cast("int").alias("blocks"))
    chunks = [(i, int(-(-s // CHUNK))) for i, s in enumerate(sizes.tolist()) if s]
    cuts = F.broadcast(cuts.join(spark.createDataFrame(chunks, "list int, chunks int"), "list"))  # a row for each list
    left = placed.join(cuts, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = asked.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meet = ["list", "chunk", "block"]

    def compare(rows, asking):
        own, found, score = [], [], []
        if rows.num_rows and asking.num_rows:
            ids, x = rows.column("id").to_numpy(), _matrix(rows.column("x"), dims, kind)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            turn = rotation(dims)
            y, borders = x @ turn, _borders(dims)
            turned = [(np.ascontiguousarray(y[:, a:b].T), a, b) for a, b in zip(borders, borders[1:])]
            q = _matrix(asking.column("x"), dims, kind)
            for own_id, one, other in zip(asking.column("id").to_pylist(), q, q @ turn):
                near, distance = scan(ids, x, turned, own_id, one, other, k)
                own += [own_id] * len(near)
                found.append(near)
                score.append(distance)
        flat = [np.array(own, np.int64), *(np.concatenate(v) if v else np.zeros(0) for v in (found, score))]
        return pa.table({"query_id": pa.array(flat[0]), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2])})

    pairs = left.select(*meet, "id", "x").groupBy(*meet).cogroup(right.select(*meet, "id", "x").groupBy(*meet)).applyInArrow(compare, schema)
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
