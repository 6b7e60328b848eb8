"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import functions as F

from wardflow.llm.stages import stored

#: Edges of a file of a round, so that a round over few edges does not write a file for each shuffle partition.
FILE_ROWS = 1 << 18


def _print_of(edges):
    """Rows and an order-free checksum."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges):
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges):
    """Every node and its smaller neighbours move to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _round(moved, n):
    """Stored edges after a star operation on n edges, which never makes them more."""
    return stored(moved.coalesce(n // FILE_ROWS + 1), "edges")


def components(edges):
    """(id, root) for every id on an edge (u, v); root is the smallest id of its component.

    Links and labels stay in tables; each round writes the edges once, and the number of
    rounds grows with the logarithm of the number of edges. Minima combine on the map side,
    so a node with very many links is not gathered anywhere.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print_of(edges)
    while before[0]:
        edges = _round(_small_star(_round(_large_star(edges), before[0])), before[0])
        after = _print_of(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
