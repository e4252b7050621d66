"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, n: int) -> DataFrame:
    """One step over edges (u, v), u < v.

    Large: a node's larger neighbours are tied to the least of the node and its
    neighbours. Small: the same for its smaller neighbours and itself. Each step
    is an aggregate with a map-side part, written before it is joined, so that
    the edges of a hub are split in the join and never meet in one place.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the least node of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    tied = [(root(x), x) for x in up if root(x) != x]
    if tied:
        u, v = zip(*tied, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


#: A partition that is reduced to stars has about so many edges.
EDGES_AT_ONCE = 200_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each node of ``edges`` (u, v: bigint); component is the least id reachable.

    Partitions are first reduced to stars on their own, one edge a node. Then
    steps go on until no edge is left of which the lesser end has a lesser
    neighbour. Empty edges give an empty table; self loops and repeated edges do
    nothing.
    """
    n = edges.count()
    parts = -(-n // EDGES_AT_ONCE) or 1
    now = scratch.save(edges.where("u <> v").coalesce(parts).mapInArrow(_local, "u bigint, v bigint"))
    while True:
        least = now.groupBy("v").agg(F.min("u").alias("u"), F.max("u").alias("most"))
        open_ends = least.where("u <> most").limit(1).count() or now.join(least.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        if not open_ends:
            break
        tied = scratch.save(_star(now, True, scratch, n), n)
        step = scratch.save(_star(tied, False, scratch, n), n)
        scratch.drop(now)
        scratch.drop(tied)
        now = step
    now = now.distinct()
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
