"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_path, written


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition: (vertex, smallest vertex that it is joined with here)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    vertices = np.fromiter(parent, np.int64, len(parent))
    tops = np.fromiter((root(x) for x in parent), np.int64, len(parent))
    own = vertices != tops
    yield pd.DataFrame({"a": vertices[own], "b": tops[own]})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component): for every vertex of ``edges`` (columns a, b: long) the smallest vertex it can reach.

    Each partition first reduces its edges to a union-find forest; then alternating large-star and small-star
    steps (minimum by partial aggregation, then a join, so that no neighbourhood is gathered in one place) run
    until the edge set is stable. Every round is written to the shared folder, and the one before it deleted. Loops, repeated edges and null
    ends are allowed and add nothing; an empty input gives an empty result. A graph that has not settled after
    ``most_rounds`` rounds raises an error rather than returning partial components.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    spark = edges.sparkSession
    path = shared_path(spark, "forest")
    now = written(pairs.mapInPandas(_forest, "a long, b long").distinct(), "forest", path)  # a > b
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        # large star: every larger neighbour of a vertex goes to the smallest vertex around it
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > k").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the vertex itself, goes to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large["a"] == least["k"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, path = path, shared_path(spark, "stars")
        now = written(small, "stars", path)
        discard(spark, last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
