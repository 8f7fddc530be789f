"""Keyed state in batch form: what the streaming operators keep, computed over whole histories (see sequences for ``piece``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import running, since


def edges(rows: DataFrame, keys: list[str], order: list[str], over: Column, name: str = "alert", piece: Column | None = None) -> DataFrame:
    """rows with a flag where ``over`` becomes true: once per crossing."""
    over = F.coalesce(over, F.lit(False))
    rows = running(rows, keys, order, "last", over, "_was", piece, before=True)
    return rows.withColumn(name, over & ~F.coalesce("_was", F.lit(False))).drop("_was")


def accepted(rows: DataFrame, keys: list[str], arrival: list[str], revision: str, piece: Column | None = None) -> DataFrame:
    """rows that a store with newest-revision-wins takes on arrival: those not older than all before them (equal ones replace)."""
    rows = running(rows, keys, arrival, "max", F.col(revision), "_top", piece, before=True)
    return rows.where(F.col("_top").isNull() | (F.col(revision) >= F.col("_top"))).drop("_top")


def settled(rows: DataFrame, keys: list[str], order: list[str], item: str, rounds: int, piece: Column | None = None) -> DataFrame:
    """rows with ``fresh`` (first sight of its item) and ``settled`` (nothing fresh in the last ``rounds`` rows).

    First sights come from a partial aggregate per (key, item); a fresh row is one at its item's first place.
    """
    first = rows.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(*(F.col(k).alias(f"_on{i}") for i, k in enumerate([*keys, item])), "_first")
    same = F.lit(True)
    for i, k in enumerate([*keys, item]):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    rows = rows.join(first, same, "left").withColumn("fresh", F.struct(*order).eqNullSafe(F.col("_first")))
    rows = rows.drop("_first", *(f"_on{i}" for i in range(len(keys) + 1)))
    rows = since(rows, keys, order, F.col("fresh"), "_since", piece)
    return rows.withColumn("settled", F.col("_since") >= rounds).drop("_since")
