"""Refreshes of a watchlist: what to ask for, in batches, and answers merged into a store, one version for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.operators.sequences import blocks, numbered
from lotwright.sources.shared import shared_path

from .watch import STALE

#: Fixed value: lots that one request asks for.
BATCH = 100
STORE = "lot_id long, max_cents long, bid_cents long, ends_ms long, refreshed_ms long, failures int, stale boolean, notified boolean"


def batched(watched: DataFrame, size: int = BATCH) -> DataFrame:
    """lot_id and batch (from 0) of every watched lot, in order of lot_id; null ids are left out."""
    rows = numbered(watched.where("lot_id IS NOT NULL").select("lot_id").distinct(), [], ["lot_id"], "n", blocks("lot_id"))
    return rows.select("lot_id", F.floor((F.col("n") - 1) / size).alias("batch"))


def requests(watched: DataFrame, size: int = BATCH) -> DataFrame:
    """batch and lot_ids: one request for each batch."""
    return batched(watched, size).groupBy("batch").agg(F.array_sort(F.collect_list("lot_id")).alias("lot_ids"))  # ``size`` ids at most


def merged(store: DataFrame, answers: DataFrame, at_ms: int | str, failed: DataFrame | None = None, size: int = BATCH) -> DataFrame:
    """The store (STORE) after one refresh, with alert: the bid has risen over the maximum for the first time.

    ``answers`` has lot_id, high_bid, seconds_left and place: of several answers for a lot the one of the greatest place counts. A bid or time
    that is null or no finite number leaves what was known. A lot without an answer, or of a batch in ``failed`` (batch), has
    missed once more, and is stale from the second miss in a row on. Answers for lots that are not watched are ignored.
    """
    best = answers.groupBy("lot_id").agg(F.max_by(F.struct("high_bid", "seconds_left"), "place").alias("answer"))
    rows = store.join(best, "lot_id", "left")
    if failed is not None:
        lost = batched(store, size).join(F.broadcast(failed.select("batch").distinct()), "batch", "left_semi").select("lot_id", F.lit(True).alias("lost"))  # a number for each 100 lots
        rows = rows.join(lost, "lot_id", "left").withColumn("answer", F.when(F.col("lost").isNull(), F.col("answer"))).drop("lost")
    got, at = F.col("answer").isNotNull(), F.lit(at_ms).cast("long")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    bid = F.coalesce(F.round(finite(F.col("answer.high_bid")) * 100).cast("long"), F.col("bid_cents"))
    over = got & ~F.col("notified") & F.coalesce(bid > F.col("max_cents"), F.lit(False))
    failures = F.when(got, 0).otherwise(F.col("failures") + 1).cast("int")
    return rows.select(
        "lot_id", "max_cents", F.when(got, bid).otherwise(F.col("bid_cents")).alias("bid_cents"),
        F.coalesce(at + (finite(F.col("answer.seconds_left").cast("double")) * 1000).cast("long"), F.col("ends_ms")).alias("ends_ms"),
        F.when(got, at).otherwise(F.col("refreshed_ms")).alias("refreshed_ms"), failures.alias("failures"), (failures >= STALE).alias("stale"), (F.col("notified") | over).alias("notified"), over.alias("alert"),
    )


class Store:
    """A watchlist below ``path``: version 0, then one for each micro-batch; the last complete one counts.

    A micro-batch that is run again after a failure finds its version or writes it anew from the one before, so the
    store has every answer once. The version before the last is kept for readers, older ones go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def create(self, watched: DataFrame) -> None:
        """Version 0 from watched: lot_id and max_cents."""
        empty = {"bid_cents": "long", "ends_ms": "long", "refreshed_ms": "long"}
        rows = watched.select("lot_id", "max_cents", *(F.lit(None).cast(t).alias(n) for n, t in empty.items()), F.lit(0).alias("failures"), F.lit(False).alias("stale"), F.lit(False).alias("notified"), F.lit(False).alias("alert"))
        rows.write.mode("overwrite").parquet(f"{self.path}/0")

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(self._file()) if self.fs.exists(self._file(x.getPath().getName(), "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(f"{STORE}, alert boolean").parquet(f"{self.path}/{self.versions()[-1] if version is None else version}")

    def refresh(self, answers: DataFrame, batch_id: int) -> None:
        """For foreachBatch: lot_id, high_bid, seconds_left, place, at_ms and batch (of a request that failed, else null)."""
        version = batch_id + 1
        if version in self.versions():
            return
        at = answers.agg(F.max("at_ms")).first()[0]
        before = self.read(max(v for v in self.versions() if v < version)).drop("alert")
        after = merged(before, answers.where("lot_id IS NOT NULL"), at, answers.where("batch IS NOT NULL"))
        after.write.mode("overwrite").parquet(f"{self.path}/{version}")
        for old in [v for v in self.versions() if v < version - 1]:
            self.fs.delete(self._file(str(old)), True)


def run_to_end(answers: DataFrame, store: Store) -> DataFrame:
    """Merges all micro-batches that a stream of answers has now; returns the store."""
    query = answers.writeStream.foreachBatch(store.refresh).option("checkpointLocation", shared_path(store.spark, "refresh")).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read()
