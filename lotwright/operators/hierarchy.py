"""Category trees from links of a child to its parent: depth, root, cycles, and all ancestors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwright.sources.shared import written


def _single(links: DataFrame) -> DataFrame:
    """One parent for each child, the smallest; a link without both ends is none."""
    return links.where("child IS NOT NULL AND parent IS NOT NULL").groupBy("child").agg(F.min("parent").alias("parent"))


def placed(links: DataFrame) -> DataFrame:
    """node, root, depth (0 at a root) and cyclic, for every child and parent of ``links`` (child, parent).

    Pointers are doubled: after k rounds each points 2**k levels up, or to its root. Nodes that still have a way to go when
    they have gone as many levels as there are links are on a cycle or below one; they have no root and no depth.
    """
    own = written(_single(links), "links")
    most = own.count()
    nodes = own.select(F.col("child").alias("node")).union(own.select("parent")).distinct()
    state = nodes.join(own, F.col("node") == F.col("child"), "left").select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("long").alias("steps"))
    state = written(state, "up")
    for _ in range(math.ceil(math.log2(most + 1)) + 1 if most else 0):
        above = state.select(F.col("node").alias("via"), F.col("up").alias("further"), F.col("steps").alias("more"))
        state = written(state.join(above, F.col("up") == F.col("via")).select("node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps")), "up")
    cyclic = F.col("steps") > most
    return state.select("node", F.when(~cyclic, F.col("up")).alias("root"), F.when(~cyclic, F.col("steps")).alias("depth"), cyclic.alias("cyclic"))


def ancestors(links: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of all nodes that are on no cycle nor below one, themselves included at distance 0.

    Distances double each round, so a tree of depth d takes log2(d) rounds.
    """
    places = written(placed(links), "placed")
    own = _single(links).join(places.where("NOT cyclic").select(F.col("node").alias("child")), "child", "left_semi")
    closed = written(own.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "closure")
    reach = 1
    deepest = places.agg(F.max("depth")).first()[0] or 0
    while reach < deepest:
        far = closed.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"))
        more = far.join(closed.select(F.col("node").alias("via"), "ancestor", "distance"), "via").select("node", "ancestor", (F.col("distance") + reach).alias("distance"))
        closed = written(closed.union(more), "closure")
        reach *= 2
    return closed.union(places.where("NOT cyclic").select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long")))


def rolled_up(facts: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """ancestor, n: facts at or below each node; facts of nodes that the tree does not know, or of null, count for themselves only."""
    counted = facts.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n"))  # before the join, so a hot category is one row a task
    rows = counted.join(ancestors(links), "node", "left").select(F.coalesce("ancestor", "node").alias("ancestor"), "n")
    return rows.groupBy("ancestor").agg(F.sum("n").alias("n"))
