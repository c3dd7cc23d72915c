"""Connected components and stable cluster names on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

#: The alternating algorithm needs O(log^2) rounds; a graph that needs more than this has a bug in it.
MAX_ROUNDS = 60


#: Graphs of up to so many distinct edges (some 30 MB in a worker) are labelled by union-find in one task; larger ones by rounds of joins.
SMALL = 200_000


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges of one task."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if kind is not None:
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([root(x) for x in ids], kind)], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int | None = None) -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id that can be reached.

    Beyond SMALL edges, large-star and small-star steps alternate until the edges form stars. A step groups by one end and joins
    the minimum back; the minimum is combined before the shuffle, and AQE splits the join of a node with very many edges. Edges
    with a null end are ignored, a loop gives the id its own component.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    nodes = materialise(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    if nodes.count() <= (SMALL if small is None else small):
        kinds = dict(nodes.dtypes)
        return nodes.coalesce(1).mapInArrow(union_find, f"id {kinds['u']}, component {kinds['v']}")
    alone = nodes.filter("u = v").select("u")
    now, first = nodes.filter("u > v"), nodes
    last = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        new = materialise(small, "edges")
        if last is not None:
            discard(last)
        now = last = new
        twice = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if now.join(now.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").select("u").union(twice).isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = stars.union(roots)
    return found.union(alone.join(found, alone["u"] == found["id"], "left_anti").select(F.col("u").alias("id"), F.col("u").alias("component")))


def cluster_name(smallest: Column) -> Column:
    """A stable 56-bit number for a cluster, from its smallest member."""
    return F.conv(F.substring(F.sha2(smallest.cast("string"), 256), 1, 14), 16, 10).cast("long")
