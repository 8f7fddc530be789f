"""Embedding near-duplicates: a subspace pigeonhole join with exact verification.

Unit vectors of cosine c or more are at a squared distance of 2 - 2c at most. After a rotation the dimensions are
split into blocks; if every block's squared distance exceeded its share of that budget (in proportion to its
dimensions), the whole would exceed the budget, so every such pair is within budget in some block. Each block is
range-joined on its own, and the union of what the blocks find is verified exactly.

A block's range join: the first coordinates of the block go to a grid whose cells are as wide as the block's radius, so
partners lie in the same or a neighbouring cell. A cell's rows and those of its forward neighbours are dealt as tiles of
bounded size; each pair of tiles is one group. Only link counts and a spanning forest leave a group, never its pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, written
from .graph import components

#: Blocks that the rotated dimensions are split into, coordinates of a block that make its grid, rows of a tile.
BLOCKS, GRID, TILE = 4, 2, 16384
#: Rotated coordinates are kept as whole multiples of 1 / SCALE, computed once, so that every group sees the same block
#: distances. SLACK, added to a block's squared budget, exceeds what that rounding changes; ROUGH that of a float32 product.
SCALE, SLACK, ROUGH = 32767, 3e-4, 1e-4


#: Cells and neighbourhoods that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=64)
def rotation(dimensions: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def block_edges(dimensions: int) -> list[tuple[int, int]]:
    cuts = [round(dimensions * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def block_budgets(dimensions: int, least: float) -> list[float]:
    """Each block's share of the squared distance that a cosine of ``least`` allows."""
    return [(2.0 - 2.0 * least) * (b - a) / dimensions for a, b in block_edges(dimensions)]


def unit_vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of an Arrow list column of ``dimensions`` finite numbers each, scaled to length 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(least: float):
    """mapInArrow function: (c, m, v) to (c, m, v, d: length, q: rotated coordinates, cells: the grid cell of each block)."""

    def work(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == d))
                q = np.rint(unit_vectors(own.column("v"), d) @ rotation(d) * SCALE).astype("<i2")
                cells = []
                for (a, b), budget in zip(block_edges(d), block_budgets(d, least)):
                    r = math.sqrt(budget + SLACK) * 1.0001
                    grid = np.floor(q[:, a : min(b, a + GRID)] / (r * SCALE)).astype(np.int64) + (1 << 20)
                    grid = np.pad(grid, ((0, 0), (0, GRID - grid.shape[1])))
                    cells.append(grid[:, 0] << 32 | grid[:, 1])
                flat = list(np.stack(cells, axis=1))
                columns = [pa.array(np.full(len(q), d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(flat, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in "cmv"), *columns], ["c", "m", "v", "d", "q", "cells"])

    return work


def _joined(least: float):
    """applyInArrow function for a pair of tiles of one length and block: link counts by class, and a forest of its links."""

    def work(got: pa.Table) -> pa.Table:
        block, dimensions = got["b"][0].as_py(), got["d"][0].as_py()
        edges, budgets = block_edges(dimensions), block_budgets(dimensions, least)
        x = unit_vectors(got["v"], dimensions)
        q = np.frombuffer(b"".join(got["q"].to_pylist()), "<i2").reshape(len(x), dimensions)
        c, m = got["c"].to_numpy(), got["m"].to_numpy()
        first = got["left"].to_numpy(zero_copy_only=False).astype(bool)
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        own = got["i"][0].as_py() == got["j"][0].as_py()  # a tile with itself
        right = left if own else right
        counts, parent = np.zeros(len(c), np.int64), np.arange(len(c))
        joined: list[np.ndarray] = []
        a, b = edges[block]
        part = q[:, a:b].astype(np.float32) / np.float32(SCALE)
        half = 0.5 * (part * part).sum(axis=1)

        def within(u: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
            a, b = edges[k]
            gap = q[u, a:b].astype(np.float64) - q[w, a:b]
            return np.einsum("ij,ij->i", gap, gap) <= (budgets[k] + SLACK) * SCALE**2

        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            # |p - q|^2 <= budget, as p.q >= |p|^2 / 2 + |q|^2 / 2 - budget / 2
            over = part[rows] @ part[right].T
            over -= (half[rows] - 0.5 * (budgets[block] + SLACK + ROUGH))[:, None]
            found = np.flatnonzero(over >= half[right][None, :])
            p, w = rows[found // len(right)], right[found % len(right)]
            if own:
                p, w = p[p < w], w[p < w]
            for s in range(0, len(p), 1 << 16):
                u, v = p[s : s + (1 << 16)], w[s : s + (1 << 16)]
                mine = within(u, v, block)
                for k in range(block):  # what an earlier block finds, it counts
                    mine &= ~within(u, v, k)
                u, v = u[mine], v[mine]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= least
                u, v = u[near], v[near]
                np.add.at(counts, u, m[v])
                np.add.at(counts, v, m[u])
                while len(u):  # hook larger labels under smaller ones until all links are inside one tree
                    pu, pv = parent[u], parent[v]
                    apart = pu != pv
                    u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
                    hi, at = np.unique(np.maximum(pu, pv), return_index=True)
                    lo = np.minimum(pu, pv)[at]
                    joined.append(np.stack([hi, lo], axis=1))
                    parent[hi] = lo
                    while not np.array_equal(parent, parent[parent]):
                        parent = parent[parent]
        some = np.flatnonzero(counts)
        ends = np.concatenate(joined) if joined else np.empty((0, 2), np.int64)
        n = np.concatenate([counts[some], np.zeros(len(ends), np.int64)])
        other = np.concatenate([np.zeros(len(some), np.int64), c[ends[:, 1]]])
        return pa.table({"c": np.concatenate([c[some], c[ends[:, 0]]]), "n": n, "other": pa.array(other, mask=np.arange(len(n)) < len(some))})

    return work


def near_duplicates(vectors: DataFrame, least: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of cosine ``least`` or more), component_id, kept.

    The cosine is that of double precision on the given components. Vectors that are null or zero, or hold null, NaN or
    infinite components, link with nothing: each is its own component. Vectors of different lengths have no cosine and
    never link: their length is part of every key, so all lengths go through one join. Vectors of equal components form one class at once;
    the rows of a class are linked with each other, as their cosine is 1. Rows without vec_id take part; a component's
    id is the smallest vec_id in it, null if it has none, and such rows are never kept. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.col("v")))
    good = rows.where("v IS NOT NULL")
    out = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.union(_linked(good, least, tile))


def _linked(rows: DataFrame, least: float, tile: int) -> DataFrame:
    """near_duplicates of vectors that all have finite components, not all zero."""
    classes = rows.groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("vec_id")).withColumn("c", F.monotonically_increasing_id())
    classes = written(classes, "vectors")
    kind = dict(classes.dtypes)["v"]
    placed = classes.select("c", "m", "v").mapInArrow(_cells(least), f"c long, m long, v {kind}, d int, q binary, cells array<bigint>")
    homes = written(placed.select("c", "m", "v", "d", "q", F.posexplode("cells").alias("b", "cell")), "cells")
    # at most (2 / radius + 2) ** GRID cells in each block of a length, whatever the number of vectors
    cells = written(homes.groupBy("d", "b", "cell").agg(F.count("*").alias("n")), "cell-sizes")
    small = F.broadcast if 9 * cells.count() <= BROADCAST_ROWS else lambda df: df  # a cell's neighbours are eight at most
    step = 1 << 32
    ahead = F.explode(F.array(*(F.lit(s).cast("long") for s in (1, step - 1, step, step + 1))))  # each pair of neighbours once
    around = cells.select("d", "b", F.col("cell").alias("home"), ahead.alias("s")).withColumn("cell", F.col("home") + F.col("s"))
    around = around.join(cells, ["d", "b", "cell"]).select("d", "b", "home", "cell", "n")
    visitors = around.groupBy("d", "b", "home").agg(F.ceil(F.sum("n") / tile).alias("q_tiles"))
    plan = cells.withColumnRenamed("cell", "home").join(visitors, ["d", "b", "home"], "left")
    plan = plan.select("d", "b", "home", F.ceil(F.col("n") / tile).alias("p_tiles"), F.coalesce("q_tiles", F.lit(0)).cast("long").alias("q_tiles"))
    visits = around.select("d", "b", "home", "cell").join(plan, ["d", "b", "home"])
    tile_of = lambda k: F.pmod(F.xxhash64("c"), F.col(k))
    upto = lambda a, b: F.explode(F.sequence(a, b))
    group, zero = ["d", "b", "home", "i", "j", "c", "m", "v", "q", "left"], F.lit(0).cast("long")
    inside = homes.withColumnRenamed("cell", "home").join(small(plan), ["d", "b", "home"]).withColumn("t", tile_of("p_tiles"))
    hosts = inside.withColumns({"i": F.col("t"), "left": F.lit(True)}).withColumn("j", upto(F.col("t"), F.col("p_tiles") + F.col("q_tiles") - 1))
    peers = inside.where("t > 0").withColumns({"j": F.col("t"), "left": F.lit(False)}).withColumn("i", upto(zero, F.col("t") - 1))
    guests = homes.join(small(visits), ["d", "b", "cell"]).withColumn("j", F.col("p_tiles") + tile_of("q_tiles"))
    guests = guests.withColumn("left", F.lit(False)).withColumn("i", upto(zero, F.col("p_tiles") - 1))
    dealt = hosts.select(group).union(peers.select(group)).union(guests.select(group))
    found = spread(dealt, "d", "b", "home", "i", "j").groupBy("d", "b", "home", "i", "j").applyInArrow(_joined(least), "c long, n long, other long")
    found = written(found, "links")
    links = found.where("other IS NOT NULL").select(F.col("c").alias("a"), F.col("other").alias("b"))
    groups = components(links).select(F.col("vertex").alias("c"), F.col("component").alias("g"))
    totals = found.where("other IS NULL").groupBy("c").agg(F.sum("n").alias("n"))
    named = classes.join(groups, "c", "left").withColumn("g", F.coalesce("g", "c")).join(totals, "c", "left")
    smallest = named.groupBy("g").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "g").select(F.col("v").alias("v2"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.join(named, F.col("v") == F.col("v2"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
