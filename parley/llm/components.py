"""Connected components of a table of links, by stars that are contracted in turn.

Each round first links every larger neighbour of a node to the smallest node around it, then every node and its smaller
neighbours to the smallest of them, until the links are stars around the smallest nodes. Groups are only reduced to their
minimum, which combines before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node on the left has one link and no node is on both sides."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("left"), F.lit(1).alias("right")))
    nodes = ends.groupBy("node").agg(F.sum("left").alias("left"), F.max("right").alias("right"))
    return nodes.filter((F.col("left") + F.col("right") > 1) & (F.col("left") > 0)).isEmpty()


def _minima(edges: DataFrame, least: Column) -> DataFrame:
    """Links with the smallest node around their left end."""
    return edges.join(edges.groupBy("a").agg(F.least(F.min("b"), least).alias("low")), "a")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) of a table of links with long columns a and b; a label is the smallest node reachable.

    Nodes without links do not appear; links of a node to itself and null ends are ignored; links may repeat.
    """
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(ordered, "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_minima(both, F.col("a")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .filter("a != b"))
        # after the large step a > b holds; the small step links a node and its smaller neighbours to the smallest
        small = _minima(large, F.min("b"))
        down = small.select("a", F.col("low").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()
        edges = materialize(down, "links")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between nodes 0..n-1."""
    above = list(range(n))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def spanning(a: np.ndarray, b: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect what links (a, b) of nodes 0..n-1 connect, and the groups after them.

    ``tops`` gives each node the smallest node of its group so far. A link is left out if its ends are in one group, so all
    calls together keep fewer links than there are nodes.
    """
    kept = []
    while len(at := np.flatnonzero(tops[a] != tops[b])):
        p, q = tops[a[at]], tops[b[at]]
        high, low = np.maximum(p, q), np.minimum(p, q)
        # each group with a smaller neighbour joins the smallest of them
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        kept.append(at[first])
        above = np.arange(len(tops))
        above[high[first]] = low[first]
        while (above[above] != above).any():
            above = above[above]
        tops = above[tops]
    return np.concatenate(kept) if kept else np.empty(0, np.int64), tops
