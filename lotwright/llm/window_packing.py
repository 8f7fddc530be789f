"""Packing of token sequences into windows by best-fit decreasing, with a segment tree over the open windows' room.

Overlong documents are first cut into full windows. What is left of them and all shorter documents are placed in descending
order of length, each into the tightest open window that takes it whole. Padding that is then left is removed by
cuts: the least filled windows are dissolved, and their pieces fill the gaps of the others, cut only where no gap takes
them whole. The last incomplete window becomes windows whose lengths are powers of two, which need no padding.

What fits together depends on lengths alone, so the plan is made over the histogram of lengths: windows of equal content
are one row, and neither the histogram nor the plan grows with the corpus. Pieces are dealt into it by rank within length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import byte_encoded, byte_encoder
from .common import small_batches, table, written

CAPACITY = 1024
#: Bits of a rank within a length in the plan's search keys.
RANK_BITS = 40


class Run(NamedTuple):
    """The slices [start, start + size) of ``n`` pieces of one length, from ``rank`` on; the largest come first."""

    order: int  # less the size
    length: int
    start: int
    rank: int
    n: int

    @property
    def size(self) -> int:
        return -self.order


@dataclass
class Part:
    """What each of a group's windows holds at ``offset``: ``per`` slices [start, start + size) of pieces of ``length``, from ``rank`` on."""

    length: int
    start: int
    size: int
    rank: int
    per: int
    offset: int


@dataclass
class Windows:
    """``n`` windows of equal content, numbered from ``base``."""

    base: int
    n: int
    room: int
    parts: list[Part]

    def split(self, n: int) -> Windows:
        """Keeps the first n windows and returns the others."""
        rest = Windows(self.base + n, self.n - n, self.room, [replace(p, rank=p.rank + n * p.per) for p in self.parts])
        self.n = n
        return rest

    def put(self, run: Run, per: int, size: int, capacity: int) -> None:
        self.parts.append(Part(run.length, run.start, size, run.rank, per, capacity - self.room))
        self.room -= per * size


class Rooms:
    """Groups of open windows by room; a segment tree counts them, so the tightest and the widest are found in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.groups: list[list[Windows]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def add(self, group: Windows) -> None:
        self.groups[group.room].append(group)
        self._count(group.room, 1)

    def take(self, room: int) -> Windows:
        self._count(room, -1)
        return self.groups[room].pop()

    def tightest(self, size: int) -> int | None:
        """The least room of an open window that is ``size`` at least."""
        i = size + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.tree[2 * i])
        return i - self.leaves

    def widest(self) -> int | None:
        if not self.tree[1]:
            return None
        i = 1
        while i < self.leaves:
            i = 2 * i + bool(self.tree[2 * i + 1])
        return i - self.leaves


class Plan:
    """Where every slice of every piece goes."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.next, self.done = capacity, 0, []
        self.rooms = Rooms(capacity)
        for length in sorted(counts, reverse=True):
            if rest := self._placed(Run(-length, length, 0, 0, counts[length])):
                self._opened(rest)
        self._closed()

    def _kept(self, group: Windows) -> None:
        if group.room:
            self.rooms.add(group)
        else:
            self.done.append(group)

    def _filled(self, run: Run, room: int, per: int, size: int) -> Run | None:
        """Puts ``per`` slices of run into each window of a group with that room, as far as either goes; returns what is left of the run."""
        group = self.rooms.take(room)
        full = min(group.n, run.n // per)
        if full < group.n:
            self.rooms.add(group.split(full))
        if full:
            group.put(run, per, size, self.capacity)
            self._kept(group)
            run = run._replace(rank=run.rank + full * per, n=run.n - full * per)
        return run if run.n else None

    def _placed(self, run: Run) -> Run | None:
        """Places run whole, best-fit; returns what no open window takes."""
        while run and (room := self.rooms.tightest(run.size)) is not None:
            run = self._filled(run, room, min(room // run.size, run.n), run.size)
        return run

    def _opened(self, run: Run) -> None:
        """New windows for a run."""
        per = self.capacity // run.size
        while run:
            group = Windows(self.next, max(1, run.n // per), self.capacity, [])
            self.next += group.n
            self.rooms.add(group)
            run = self._filled(run, self.capacity, min(per, run.n), run.size)

    def _closed(self) -> None:
        """Removes the padding of the open windows; those whose fill is a power of two have none."""
        opened = [g for own in self.rooms.groups for g in own]
        self.rooms = Rooms(self.capacity)
        fill = lambda g: self.capacity - g.room
        self.done += [g for g in opened if fill(g) & (fill(g) - 1) == 0]
        opened = sorted((g for g in opened if fill(g) & (fill(g) - 1)), key=lambda g: (g.room, g.base))
        left = sum(g.n * fill(g) for g in opened) // self.capacity  # windows that can be filled
        runs: list[Run] = []
        for group in opened:
            other = group.split(min(left, group.n))
            left -= group.n
            if group.n:
                self.rooms.add(group)
            if other.n:
                runs += [Run(-p.size, p.length, p.start, p.rank, p.per * other.n) for p in other.parts]
        heapq.heapify(runs)
        last: list[Run] = []
        while runs:
            run = self._placed(heapq.heappop(runs))
            while run and (room := self.rooms.widest()) is not None and room < run.size:  # a cut: the head fills the gap
                n = min(run.n, self.rooms.groups[room][-1].n)
                heapq.heappush(runs, Run(run.order + room, run.length, run.start + room, run.rank, n))
                run = self._filled(run, room, 1, room)
            if run and self.rooms.tightest(run.size) is not None:
                heapq.heappush(runs, run)
            elif run:
                last.append(run)
        self._last(last)

    def _last(self, runs: list[Run]) -> None:
        """Windows of descending powers of two for less than a window's tokens."""
        ones = [Run(r.order, r.length, r.start, r.rank + k, 1) for r in runs for k in range(r.n)][::-1]
        total = sum(r.size for r in ones)
        for power in reversed(range(total.bit_length())):
            if not total >> power & 1:
                continue
            group = Windows(self.next, 1, 1 << power, [])
            self.next += 1
            while group.room:
                run = ones.pop()
                size = min(run.size, group.room)
                group.put(run, 1, size, 1 << power)
                if size < run.size:
                    ones.append(Run(run.order + size, run.length, run.start + size, run.rank, 1))
            self.done.append(group)

    def arrays(self) -> dict[str, np.ndarray]:
        """One row for each part, ordered by ``key``: (length, start, rank) in one number."""
        rows = sorted((self.key(p.length, p.start, p.rank), p.rank, p.size, p.per, p.offset, g.base) for g in self.done for p in g.parts)
        return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("key", "rank", "size", "per", "offset", "base"))}

    def key(self, length, start, rank):
        return ((length * (self.capacity + 1) + start) << RANK_BITS) | rank

    def cut(self) -> list[int]:
        """Lengths of pieces that are cut."""
        return sorted({p.length for g in self.done for p in g.parts if p.size < p.length})


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Full windows of the documents and what is left of them: doc_id, start, length, ids_crc32, doc_tokens, ids, and (part, k): the k-th piece of this length in task ``part``.

    ``ids`` are 16-bit where the vocabulary has no more, and null for full windows, which are never cut.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        kind = narrow(vocabulary, end_id)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for row, ids in byte_encoded(vocabulary, (x.as_py() for x in batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    kept = own.astype(kind).tobytes() if len(own) < capacity else None
                    out.append((names[row], at, len(own), zlib.crc32(own), len(ids), kept, part, int(met[len(own)])))
                    met[len(own)] += 1
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "k"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part long, k long")


def narrow(vocabulary: str, end_id: int) -> str:
    return "<u2" if max(byte_encoder(vocabulary).vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids and ``end_id``. Every sequence is full or has a length that is a power of two, so none is padded.
    Null and empty texts are ``end_id`` alone. Repeated rows are packed as often as they occur, and a null doc_id is
    kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        rows = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan.arrays())
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = parts.select(F.col("length").alias("l"), F.col("part").alias("p"), (F.sum("n").over(earlier) - F.col("n")).alias("first"))
    ids = F.when(F.col("length").isin(plan.cut()), F.col("ids")) if plan.cut() else F.lit(None).cast("binary")
    rows = rows.withColumn("ids", ids)
    ranked = rows.join(firsts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("k") + F.col("first")).alias("rank"))
    key = plan.key

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = shared.value, narrow(vocabulary, end_id)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            todo, inner = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(todo):
                at = np.searchsorted(own["key"], key(length[todo], inner, rank[todo]), "right") - 1
                size, within = own["size"][at], rank[todo] - own["rank"][at]
                crc = batch.column("ids_crc32").to_numpy()[todo]
                for i in np.flatnonzero(size < length[todo]):
                    ids = np.frombuffer(batch.column("ids")[int(todo[i])].as_py(), kind)[inner[i] : inner[i] + size[i]]
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                sequence = own["base"][at] + within // own["per"][at]
                offset = own["offset"][at] + within % own["per"][at] * size
                start = batch.column("start").to_numpy()[todo] + inner
                columns = [batch.column("doc_id").take(pa.array(todo)), *map(pa.array, (start, size, crc)), batch.column("doc_tokens").take(pa.array(todo)), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                more = inner + size < length[todo]
                todo, inner = todo[more], (inner + size)[more]

    return ranked.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
