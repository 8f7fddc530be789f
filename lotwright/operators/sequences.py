"""Positional operators: groups under headers, runs, ranges, transitions.

A scan along a key runs on two levels, so that no key's history is sorted in one task: windows within (key, piece), then
one row per piece along the key, whose result is carried into the piece. ``piece`` is a value that never falls in the scan's order
(an hour of its time, a block of its ids); a null piece comes first, as nulls do. Without one, a key is taken to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a block, milliseconds of a span: what one piece of a key may hold.
BLOCK, SPAN = 1 << 16, 3_600_000
#: How the state before a piece and that within it combine.
COMBINED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "max": F.greatest,
    "last": lambda carried, own: F.coalesce(own, carried),
}


def blocks(ids: str | Column) -> Column:
    return F.floor((F.col(ids) if isinstance(ids, str) else ids) / BLOCK)


def spans(at: str) -> Column:
    """Pieces of a time: a timestamp or milliseconds."""
    return F.floor(F.unix_millis(F.col(at).cast("timestamp")) / SPAN)


def _carried(rows: DataFrame, pieces: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """rows with the named columns of their piece."""
    on = [*keys, "_piece"]
    state = pieces.select(*(F.col(k).alias(f"_on{i}") for i, k in enumerate(on)), *names)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(on)))
    return rows.join(state, same, "left").drop(*(f"_on{i}" for i in range(len(on))))


def running(rows: DataFrame, keys: list[str], order: list[str], kind: str, value: Column, name: str, piece: Column | None = None, before: bool = False) -> DataFrame:
    """rows with the sum, max or last non-null ``value`` over the rows of their key up to them, or before them.

    ``order`` is total within a key. Without a row or value so far the sum is 0, the others are null.
    """
    upto = (Window.unboundedPreceding, -1 if before else Window.currentRow)
    over = {"sum": F.sum("_v"), "max": F.max("_v"), "last": F.last("_v", ignorenulls=True)}[kind]
    rows = rows.withColumn("_v", value)
    if piece is None:
        own = over.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto))
        return rows.withColumn(name, F.coalesce(own, F.lit(0)) if kind == "sum" else own).drop("_v")
    rows = rows.withColumn("_piece", piece)
    whole = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))) if kind == "last" else over
    pieces = rows.groupBy(*keys, "_piece").agg(whole.alias("_v"))
    along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_carry", over.over(along))
    rows = rows.withColumn("_own", over.over(Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(*upto)))
    rows = _carried(rows, pieces, keys, ["_carry"])
    return rows.withColumn(name, COMBINED[kind](F.col("_carry"), F.col("_own"))).drop("_v", "_piece", "_own", "_carry")


def since(rows: DataFrame, keys: list[str], order: list[str], mark: Column, name: str, piece: Column | None = None) -> DataFrame:
    """rows with the number of rows after the last marked one of their key, themselves included; all so far if there is none."""
    rows = rows.withColumns({"_piece": F.lit(0) if piece is None else piece, "_mark": F.coalesce(mark, F.lit(False))})
    w = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_m", F.max(F.when(F.col("_mark"), F.col("_n"))).over(w))
    if piece is None:
        rows = rows.withColumns({"_start": F.lit(0), "_last": F.lit(None).cast("long")})
    else:
        along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = rows.groupBy(*keys, "_piece").agg(F.max("_n").alias("_n"), F.max("_m").alias("_m"))
        pieces = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        pieces = pieces.withColumn("_last", F.max(F.col("_start") + F.col("_m")).over(along))
        rows = _carried(rows, pieces, keys, ["_start", "_last"])
    last = F.coalesce(F.col("_start") + F.col("_m"), F.col("_last"), F.lit(0))
    return rows.withColumn(name, F.col("_start") + F.col("_n") - last).drop("_piece", "_mark", "_n", "_m", "_start", "_last")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, piece: Column | None = None) -> DataFrame:
    """rows with their place along their key, from 1."""
    return running(rows, keys, order, "sum", F.lit(1), name, piece)


def under_headers(rows: DataFrame, keys: list[str], order: list[str], is_header: Column, value: Column, name: str, piece: Column | None = None) -> DataFrame:
    """rows with the value of the last header at or before them."""
    return running(rows, keys, order, "last", F.when(is_header, value), name, piece)


def failure_runs(rows: DataFrame, keys: list[str], order: list[str], failed: Column, stale_at: int = 2, piece: Column | None = None) -> DataFrame:
    """rows with the number of failures since the last success, and whether that is stale."""
    rows = since(rows, keys, order, ~F.coalesce(failed, F.lit(False)), "failures", piece)
    return rows.withColumn("stale", F.col("failures") >= stale_at)


def transitions(rows: DataFrame, keys: list[str], order: list[str], phase: str, piece: Column | None = None) -> DataFrame:
    """rows with the phase before them."""
    rows = running(rows, keys, order, "last", F.struct(F.col(phase).alias("was")), "before", piece, before=True)
    return rows.withColumn("before", F.col("before.was"))


def contiguous(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key: ranges, the gaps and overlaps between neighbours, and whether there are none."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    step = F.col(start) - F.lag(end).over(w)
    return ranges.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("ranges"),
        F.count_if(F.col("_step") > 1).alias("gaps"),
        F.count_if(F.col("_step") < 1).alias("overlaps"),
        F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)).alias("exact"),
    )


def islands(rows: DataFrame, keys: list[str], order: list[str], gap: Column, piece: Column | None = None) -> DataFrame:
    """rows with the number of their burst, from 0: a new one begins where the first order column is more than ``gap`` from the row before."""
    rows = running(rows, keys, order, "last", F.struct(F.col(order[0]).alias("was")), "_was", piece, before=True)
    opens = F.when(F.col(order[0]) - F.col("_was.was") > gap, 1).otherwise(0)
    return running(rows, keys, order, "sum", opens, "burst", piece).drop("_was")
