"""A keyed store that a log of changes is merged into: inserts, updates of single columns, deletes with tombstones.

Every change has a sequence number, and the store keeps the last one of each key, tombstones included, so changes that
come again change nothing and an old change cannot bring a deleted row back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwright.sources.shared import written
from lotwright.sources.sinks import replace_partitions

#: The bounds of a premium in per cent.
LEAST_RATE, MOST_RATE = 0, 30


def lot_fault(lot_id: Column) -> Column:
    """Why a lot cannot be watched; null if it can."""
    return F.when(F.coalesce(lot_id.cast("string"), F.lit("")) == "", "invalid_lot")


def premium_fault(key: Column, rate: Column) -> Column:
    """Why a premium cannot be stored; null if it can."""
    fits = (F.coalesce(key.cast("string"), F.lit("")) != "") & ~F.isnan(rate) & rate.between(LEAST_RATE, MOST_RATE)
    return F.when(~F.coalesce(fits, F.lit(False)), "invalid_premium")


def folded(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key: last (its greatest seq), reset (its last insert or delete) and patch_c, the last update of each column.

    One aggregate that combines before its shuffle, so a key with a third of all changes is a row for each task.
    """
    own = F.struct("seq", "op", F.struct(*columns).alias("row"))
    patch = lambda c: F.max(F.when((F.col("op") == "update") & F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(f"patch_{c}")
    return changes.where(F.col(key).isNotNull() & F.col("seq").isNotNull()).groupBy(key).agg(F.max("seq").alias("last"), F.max(F.when(F.col("op").isin("insert", "delete"), own)).alias("reset"), *map(patch, columns))


def applied(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The store after the changes. Columns of the store: key, seq, deleted and what it holds; of changes: key, seq, op and the same.

    ``insert`` replaces a row or brings it back, ``update`` sets the columns that are not null and does nothing to a row that is not
    there, ``delete`` leaves a tombstone without values. Changes of a key count in order of seq, and only those after the
    store's; of two with one seq, the greater. Rows without key or seq are left out; an unknown op moves seq on only.
    """
    columns = [c for c in store.columns if c not in (key, "seq", "deleted")]
    new = folded(changes, key, columns)
    both = store.withColumn("_was", F.struct("seq", "deleted", F.struct(*columns).alias("row"))).select(key, "_was").join(new, key, "full")
    seq = F.coalesce(F.col("_was.seq"), F.lit(None).cast("long"))
    fresh = lambda c: F.col(c).isNotNull() & (seq.isNull() | (F.col(f"{c}.seq") > seq))
    reset = fresh("reset")
    live = F.when(reset, F.col("reset.op") == "insert").otherwise(F.coalesce(~F.col("_was.deleted"), F.lit(False)))
    since = F.greatest(F.when(reset, F.col("reset.seq")), seq)

    def value(c: str) -> Column:
        patched = F.col(f"patch_{c}").isNotNull() & (since.isNull() | (F.col(f"patch_{c}.seq") > since))
        base = F.when(reset, F.col(f"reset.row.{c}")).otherwise(F.col(f"_was.row.{c}"))
        return F.when(live, F.when(patched, F.col(f"patch_{c}.v")).otherwise(base)).alias(c)

    return both.select(key, F.greatest(seq, F.col("last")).alias("seq"), (~live).alias("deleted"), *map(value, columns))


def merge(path: str, changes: DataFrame, key: str, buckets: int) -> None:
    """Merges changes into the store below ``path``, a Parquet folder by bucket of the key; only buckets with changes are read and replaced.

    A run that fails half way is simply run again: buckets that were replaced already ignore their changes.
    """
    spark = changes.sparkSession
    placed = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    store = spark.read.parquet(path)
    after = applied(store.where(F.col("bucket").isin(touched)).drop("bucket"), placed.drop("bucket"), key)
    after = written(after.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "merged")
    replace_partitions(after, path, ["bucket"])


def create(path: str, rows: DataFrame, key: str, buckets: int) -> None:
    """A new store of rows, which have key, seq, deleted and values."""
    replace_partitions(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), path, ["bucket"])


def live(path: str, spark) -> DataFrame:
    """The rows that are there."""
    return spark.read.parquet(path).where("NOT deleted").drop("deleted", "bucket")
