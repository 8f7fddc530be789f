"""Where results go: gated exports, delimited text, keyed tables with newest-revision upserts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwright.operators import keyed

from .batches import write_quoted


def gated(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """rows, if every row of the audit is complete; evaluating the result fails with the first reason otherwise."""
    state = audit.agg(F.bool_and("complete").alias("_ok"), F.min(F.when(~F.col("complete"), F.coalesce("reason", F.lit("incomplete")))).alias("_why"))
    checked = state.select(F.when(F.coalesce("_ok", F.lit(False)), F.lit(1)).otherwise(F.raise_error(F.concat(F.lit("capture is not complete: "), F.coalesce("_why", F.lit("no audit"))))).alias("_gate"))
    return rows.crossJoin(F.broadcast(checked)).where("_gate = 1").drop("_gate")  # one row


def to_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_csv(rows: DataFrame, path: str) -> None:
    """A bare header, every cell quoted, quotes doubled, lines parted by CRLF; null and empty cells are alike."""
    write_quoted(rows, path)


def to_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that rows belong to and leaves the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upserted(stored: DataFrame, incoming: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest revision of each key; of equal revisions the incoming row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return keyed.best(both, [key], F.struct(revision, "_new")).drop("_new")


def alive(cache: DataFrame, now_ms: int) -> DataFrame:
    return cache.where(F.col("expires_at") > now_ms)
