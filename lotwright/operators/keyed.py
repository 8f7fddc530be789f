"""One row per key: latest, newest, best, first and merged rows, by aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """The row of each key with the largest ``order`` (a struct for several criteria, made total by the caller).

    A hot key costs no more than any other: each task keeps one row per key before the shuffle.
    """
    columns = columns or [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns))


def first(rows: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The row of each key at the smallest position."""
    columns = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), position).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns))


def keep_newest(parents: DataFrame, children: DataFrame, key: str, age: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The n newest parents, and the children that go with them; ties are broken by key."""
    kept = parents.orderBy(F.desc(age), F.desc(key)).limit(n)
    return kept, children.join(F.broadcast(kept.select(key)), key, "left_semi")  # n rows


def merged(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Last writer wins for each column by itself: the last non-null value in order of ``sequence``."""
    columns = [c for c in rows.columns if c not in (key, sequence)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence)))
    return rows.groupBy(key).agg(*(last(c).alias(c) for c in columns), F.max(sequence).alias(sequence))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
