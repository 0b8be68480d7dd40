"""Connected components of an edge table by alternating star contractions, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


#: From so many edges on, hubs are looked for; a hub has at least one edge end in so many, so there are as many hubs at most.
HUB_EDGES, HUBS = 1 << 20, 1 << 10


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Link each node's larger (or, else, not larger) neighbours to the least of the node and its neighbours."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    counted = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    least = counted.drop("n")
    if large and n_edges >= HUB_EDGES:
        # The few hubs are broadcast, so that none of them is one key of a shuffle.
        hubs = F.broadcast(counted.filter(F.col("n") > 2 * n_edges // HUBS).drop("n"))
        joined = pairs.join(hubs, "u").unionByName(pairs.join(hubs.select("u"), "u", "left_anti").join(least, "u"))
    else:
        joined = pairs.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id``, ``root`` (the least id that links reach) for every node of an edge; ``edges`` has bigint a, b.

    Each round stores its edges in the shared folder and needs sums of them only; the number of rounds
    grows with the logarithm of the longest chain. A node that holds a large share of all edges (a component of a
    third of all nodes becomes a star) is one of at most ``HUBS`` hubs; their least neighbours are found
    with partial aggregates and broadcast, so their edges stay where they are. Repeated edges, both
    directions and loops are fine; an edge with a null end is ignored.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash(edges, "edges")
    before = _state(now)
    while before[0]:
        new = stash(_star(_star(now, True, before[0]), False, before[0]), "edges")
        unstash(now)
        now = new
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
