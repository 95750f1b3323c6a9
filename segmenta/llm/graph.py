"""Connected components of an edge table, by label propagation towards hubs and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_saved, saved

#: an edge table of at most so many rows is solved in one piece (16 bytes a row: 3.2 MB)
SMALL_EDGES = 200_000


def _solve(pairs: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def components(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that links reach.

    Rounds of large-star and small-star: each shuffles every edge once or twice, the
    number of edges never grows, and rounds grow with the logarithm of the longest path.
    A hub's edges are reduced by min before they are dealt out. Nulls must not occur;
    repeated edges and loops are fine; no edges give no rows. small_edges=0 forces the rounds.
    """
    spark = edges.sparkSession
    e = saved(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = e.count()
    if n <= small_edges:
        found = _solve([(r.u, r.v) for r in e.collect()])
        drop_saved(e)
        return spark.createDataFrame(list(found.items()) or [], "node long, root long")
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = saved(small.select("u", "v"), "small")
        same = nxt.count() == e.count() and not nxt.exceptAll(e).head(1)
        drop_saved(e, large)
        e = nxt
        if same:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
