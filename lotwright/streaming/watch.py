"""A watchlist as keyed streaming state: rows in order of event time, late answers rejected, alerts and alarms once each."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "lot_id long, kind string, at_ms long"
#: Minutes before the end of a lot at which it is announced, at the earliest so many milliseconds after its end became known; misses in a row after which it is stale. Fixed values.
ALARMS, SOONEST, STALE = (15, 2), 1000, 2
#: Rows that are sorted in memory at once, and of a piece of what waits in the state.
RUN, CHUNK = 16_384, 256
#: How long after its end a lot without news is forgotten.
KEEP_MS = 40 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a row may lack, and what it then is.
OPTIONAL = {"kind": "'answer'", "generation": "CAST(NULL AS BIGINT)", "fingerprint": "CAST(NULL AS STRING)", "seq": "revision"}
ROW = ["at_ms", "seq", "kind", "generation", "fingerprint", "revision", "ok", "over", "ends_ms"]


@dataclass
class Lot:
    """What is known of a watched lot. Rows are taken in order of time; both methods return alerts (kind, at)."""

    generation: int | None = None
    fingerprint: str | None = None
    revision: int | None = None
    failures: int = 0
    over: bool = False
    seen: int | None = None
    ends: int | None = None
    fired: list[int] = field(default_factory=list)
    touched: int = 0

    def take(self, at: int, seq: int, kind: str, generation: int | None, fingerprint: str | None, revision: int | None, ok: bool, over: bool, ends: int | None) -> list[tuple[str, int]]:
        self.touched = at
        if kind == "ask":  # a new refresh: answers to earlier ones are late from now on
            if generation is not None and (self.generation is None or generation > self.generation):
                self.generation, self.fingerprint = generation, fingerprint
            return []
        if generation != self.generation or fingerprint != self.fingerprint:
            return [("late", at)]
        if not ok:
            self.failures += 1
            return [("stale", at)] if self.failures == STALE else []
        if revision is not None and self.revision is not None and revision < self.revision:
            return [("late", at)]
        self.revision, self.failures, self.seen, self.ends = self.revision if revision is None else revision, 0, at, ends
        crossed, self.over = self.over, over
        return [("over_max", at)] if self.over and not crossed else []

    def due(self) -> list[tuple[int, int]]:
        """(time, minutes before the end) of the alarms to come."""
        if self.ends is None or self.ends <= self.seen:
            return []
        return sorted((max(self.seen + SOONEST, self.ends - 60_000 * k), k) for k in ALARMS if k not in self.fired)

    def alarms(self, before: int) -> list[tuple[str, int]]:
        """Announces what is due before a time, each kind once in a lot's life."""
        out = [(f"alarm_{k}", at) for at, k in self.due() if at < before]
        self.fired += [int(x[0].removeprefix("alarm_")) for x in out]
        return out


def _packed(lot: Lot) -> str:
    return json.dumps(list(vars(lot).values()))


class Watch(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them, in sorted runs of small pieces, and are then merged.

    So the order of arrival does not matter, and a lot with any number of rows needs the memory of one run while
    they arrive and of one piece of each run while they are merged.
    """

    def __init__(self, keep_ms: int = KEEP_MS, run: int = RUN, chunk: int = CHUNK):
        self.keep_ms, self.run, self.chunk = keep_ms, run, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # every call to the state is a round trip: one value holds the lot, its runs (of each: number, piece, row in it, pieces, time of that row), and the rows of a last run of 0 pieces
        self.known = handle.getValueState("known", "lot string, next long, runs array<array<long>>, last string")
        self.pieces = handle.getMapState("pieces", "run long, piece long", "rows string")

    def _waiting(self) -> tuple[str, int, list[list[int]], str]:
        found = self.known.get()
        if found is None:
            return _packed(Lot()), 0, [], ""
        lot, number, runs, last = found
        return lot, number, [list(x) for x in runs], last

    def _piece(self, run: list[int], last: str) -> list[list]:
        return [[row.get(name) for name in ROW] for row in json.loads(self.pieces.getValue((run[0], run[1]))[0] if run[3] else last)]

    def _read(self, row: Row) -> tuple:
        """The place of a row in the order of its lot, and its text."""
        text = row[-1]
        said = json.loads(text)
        return self._place((said["at_ms"], said.get("seq"))), text

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lot, number, runs, last = self._waiting()
        while own := sorted(map(self._read, islice(rows, self.run)), key=lambda x: x[0]):
            if last:  # is no longer the last one
                self.pieces.updateValue((runs[-1][0], 0), (last,))
                runs[-1][3], last = 1, ""
            pieces = [f"[{','.join(text for _, text in own[k : k + self.chunk])}]" for k in range(0, len(own), self.chunk)]
            if len(pieces) == 1:
                last = pieces.pop()
            for k, piece in enumerate(pieces):
                self.pieces.updateValue((number, k), (piece,))
            runs.append([number, 0, 0, len(pieces), own[0][0][0]])
            number += 1
        self.known.update((lot, number, runs, last))
        self.handle.registerTimer(min(r[4] for r in runs) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        alert = lambda x: Row(lot_id=key[0], kind=x[0], at_ms=x[1])
        lot, number, runs, last = self._waiting()
        lot = Lot(*json.loads(lot))
        later = [r for r in runs if r[4] >= now]
        for row in self._merged([r for r in runs if r[4] < now], now, later, last):
            yield from map(alert, lot.alarms(row[0]))
            if self._forgotten(lot) < row[0]:
                lot = Lot()
            yield from map(alert, lot.take(*row))
        yield from map(alert, lot.alarms(now))
        if not later and self._forgotten(lot) < now:
            self.known.clear()
            return
        later.sort()
        self.known.update((_packed(lot), number, later, last if later and not later[-1][3] else ""))
        self.handle.registerTimer(max(now, min([r[4] for r in later] + [at for at, _ in lot.due()] + [self._forgotten(lot)])) + 1)

    def _forgotten(self, lot: Lot) -> int:
        """When a lot is forgotten if nothing more comes."""
        return max(lot.touched, lot.ends or 0) + self.keep_ms

    def _merged(self, runs: list[list[int]], now: int, later: list[list[int]], last: str) -> Iterator[list]:
        """The waiting rows before ``now`` in order; what is left of the runs goes to ``later``."""
        heap = []
        for run in runs:
            rows = self._piece(run, last)
            heap.append((self._place(rows[run[2]]), run[0], run, rows))
        heapq.heapify(heap)
        while heap:
            place, _, run, rows = heap[0]
            if place[0] >= now:
                later += [[*x[2][:4], x[0][0]] for x in heap]
                return
            yield rows[run[2]]
            run[2] += 1
            if run[2] == len(rows):
                if run[3]:
                    self.pieces.removeKey((run[0], run[1]))
                run[1], run[2] = run[1] + 1, 0
                if run[1] >= run[3]:
                    heapq.heappop(heap)
                    continue
                rows = self._piece(run, last)
            heapq.heapreplace(heap, (self._place(rows[run[2]]), run[0], run, rows))

    @staticmethod
    def _place(row: list | tuple) -> tuple:
        return row[0], row[1] is not None, row[1] or 0


def watch(refreshes: DataFrame, lateness: str = "10 minutes", processor: Watch | None = None) -> DataFrame:
    """Alerts of a stream of refreshes: lot_id, at, revision, ok, bid, ceiling, ends_ms, and any of OPTIONAL.

    Rows of kind ``ask`` begin a generation with a fingerprint; an answer of another generation or fingerprint than its lot's
    is ``late``, and so is one of an older revision than the lot's. A refresh that failed is a miss, and the second in a row
    makes the lot ``stale``. A bid that rises over the ceiling alerts once until it has been under it again. Fifteen and two
    minutes before the end each lot is announced once, when the watermark passes. A row that comes after the watermark has
    passed it is dropped. Equal times are by seq (the revision, where there is none). What is known of a lot is bounded, and
    goes the processor's ``keep_ms`` after the lot's end.
    """
    rows = refreshes.withWatermark("at", lateness)
    rows = rows.withColumns({name: F.expr(x) for name, x in OPTIONAL.items() if name not in rows.columns})
    over = F.coalesce((F.col("bid") > F.col("ceiling")) & ~F.isnan(F.col("bid").cast("double")), F.lit(False))
    said = F.struct(F.unix_millis("at").alias("at_ms"), *(over.alias(name) if name == "over" else F.col(name) for name in ROW[1:]))
    rows = rows.select("lot_id", "at", F.to_json(said).alias("said"))  # one text, as every cell of a row costs the Python worker as much as all that is done with it
    return rows.groupBy("lot_id").transformWithState(processor or Watch(), OUT, "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, on disk, as timers and maps need it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_end(alerts: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source has now, and reads back what it wrote below ``folder``."""
    spark = alerts.sparkSession
    out = f"{folder}/alerts-{uuid.uuid4().hex}"
    with rocks(spark):
        query = alerts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{out}/rows")


def refreshes_of_events(rows: DataFrame) -> DataFrame:
    """The events table as refreshes: a click asks, an error is a miss, the value of another event is the bid.

    The generation is a span of six days: that of a click, and for answers that of up to three days before. Every seventh row has
    another fingerprint, and revisions fall now and then.
    """
    at, n = F.col("ts").cast("timestamp"), F.col("event_id")
    asks = F.col("event_type") == "click"
    span = F.floor((F.unix_millis(at) - F.when(asks, 0).otherwise(n % 4) * 86_400_000) / 518_400_000)
    return rows.select(
        F.col("user_id").alias("lot_id"), at.alias("at"), n.alias("seq"), F.when(asks, "ask").otherwise("answer").alias("kind"), span.alias("generation"), F.when(n % 7 == 0, "b").otherwise("a").alias("fingerprint"),
        (n - n % 5 * 400).alias("revision"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("bid"), F.lit(80.0).alias("ceiling"), (F.unix_millis(at) + 20 * 60_000).alias("ends_ms"),
    )


def alerts_of_events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the source is one file or a folder of them
    return run_to_end(watch(refreshes_of_events(source)), folder)
