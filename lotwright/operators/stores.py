"""Stores of keyed objects: references, second-choice sources, plans that are migrated once, repeated ids, audited partial exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referenced(store: DataFrame, roots: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Objects that roots list by reference, each with the object that it refers to itself.

    ``store`` has key and body (JSON); ``roots`` are those rows of it whose body lists ``results`` of {"__ref": key}. ``fields`` are
    paths in the listed object (``$.…``) or the one it refers to by its auction (``auction:$.…``). A reference to nothing gives nulls.
    """
    listed = roots.select(F.explode(F.from_json("body", "results array<struct<__ref: string>>")["results"]["__ref"]).alias("ref"))
    own = store.select(F.col("key").alias("ref"), F.col("body").alias("own"))
    other = store.select(F.col("key").alias("to"), F.col("body").alias("other"))
    rows = listed.join(own, "ref", "left").withColumn("to", F.get_json_object("own", "$.auction.__ref")).join(other, "to", "left")
    return rows.select("ref", *(F.get_json_object("other" if path.startswith("auction:") else "own", path.removeprefix("auction:")).alias(name) for name, path in fields.items()))


def stored_state(lots: DataFrame, stored: DataFrame, watched: DataFrame, key: str) -> DataFrame:
    """lots with resale and max_bid of their stored state; where that has none, the watchlist's, which is in cents."""
    first = stored.select(key, F.col("resale").alias("_r"), F.col("max_bid").alias("_m"))
    second = watched.select(key, (F.col("resale_cents") / 100).alias("_rc"), (F.col("max_bid_cents") / 100).alias("_mc"))
    rows = lots.join(first, key, "left").join(second, key, "left")
    return rows.withColumn("resale", F.coalesce("_r", "_rc")).withColumn("max_bid", F.coalesce("_m", "_mc")).drop("_r", "_m", "_rc", "_mc")


def first_repeats(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, repeated_at, n): keys that occur more than once, with the position of their second occurrence, by which they are ordered."""
    seen = rows.groupBy(key).agg(F.min(position).alias("_first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(seen.select(key, "_first"), key).where(F.col(position) > F.col("_first")).groupBy(key).agg(F.min(position).alias("repeated_at"))
    return again.join(seen.select(key, "n"), key).orderBy("repeated_at", key)


def migrated_plans(plans: DataFrame, legacy: DataFrame) -> DataFrame:
    """(plan, lot, max, migrated): each plan's entries, the first one per lot kept; legacy entries go once, into the plan opened first.

    ``plans`` has plan, lot, max, at; ``legacy`` lot and max. An entry of that plan is not replaced by a legacy one.
    """
    own = plans.groupBy("plan", "lot").agg(F.min_by(F.struct("max"), "at").alias("_e")).select("plan", "lot", F.col("_e.max").alias("max"), F.lit(False).alias("migrated"))
    opened = plans.agg(F.min_by("plan", "at").alias("plan"))  # one row
    old = legacy.crossJoin(F.broadcast(opened)).select("plan", "lot", "max", F.lit(True).alias("migrated")).where("plan IS NOT NULL")
    return own.union(old.join(own.select("plan", "lot"), ["plan", "lot"], "left_anti"))


def partial_export(expected: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, expected, items, missing, complete, partial) of each capture: ``expected`` has key and id (a null id says that nothing is expected), ``items`` key and id.

    ``missing`` counts the expected ids that no item has; ``missing_ids`` lists them. A partial export is always said to be one.
    """
    wanted = expected.groupBy(key).agg(F.count("id").alias("expected"))
    found = items.groupBy(key).agg(F.count("*").alias("items"))
    gone = missing_ids(expected, items, key).groupBy(key).agg(F.count("*").alias("missing"))
    rows = wanted.join(found, key, "left").join(gone, key, "left").fillna(0, ["items", "missing"])
    whole = (F.col("missing") == 0) & (F.col("items") == F.col("expected"))
    return rows.select(key, "expected", "items", "missing", whole.alias("complete"), (~whole).alias("partial"))


def missing_ids(expected: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, id) that is expected and that no item has."""
    return expected.where("id IS NOT NULL").select(key, "id").distinct().join(items.select(key, "id"), [key, "id"], "left_anti")
