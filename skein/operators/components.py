"""Connected components of an edge table, as alternating star contractions that Spark shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import Stored, store
from skein.sources.ship import ship


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Each round points all larger neighbours of a node, then all smaller ones, at the least of
    them. A hub's neighbours are never gathered: its minimum is a partial aggregate, joined
    back to its edges, which Spark can split by skew. Rounds end when the edge set stays as
    it was; their number grows with the logarithm of the longest path. Loops and repeated
    edges don't matter; an empty table gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if all(t == "bigint" for _, t in edges.dtypes):
        ship(edges.sparkSession)
        edges = edges.mapInPandas(_forest, "a bigint, b bigint")
    now = store(edges.distinct())
    before = None
    for _ in range(rounds):
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = _replace(now, _small_star(_large_star(now.df)))
    else:
        raise RuntimeError("connected_components: not settled")
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


#: Edges that a task looks at together.
TOGETHER = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of some of a task's edges at a time those that connect what was apart: the same components, in fewer edges than these have nodes."""
    have, n = [], 0
    for pdf in batches:
        have.append(pdf)
        n += len(pdf)
        if n >= TOGETHER:
            yield spanning(pd.concat(have), "a", "b")
            have, n = [], 0
    if have:
        yield spanning(pd.concat(have), "a", "b")


def spanning(edges: pd.DataFrame, one: str, other: str) -> pd.DataFrame:
    """The edges that connect what those before them leave apart."""
    parent: dict[int, int] = {}
    keep = []
    for n, (a, b) in enumerate(zip(edges[one].tolist(), edges[other].tolist(), strict=True)):
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[p]
        while (p := parent.setdefault(b, b)) != b:
            parent[b] = b = parent[p]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(n)
    return edges.iloc[keep]


def _replace(old: Stored, df: DataFrame) -> Stored:
    new = store(df)
    old.drop()
    return new


def _large_star(e: DataFrame) -> DataFrame:
    """e has a > b. For each u: every neighbour above u gets an edge to the least of u and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """For each u: u and every neighbour below it get an edge to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
