"""Best-fit packing of token sequences by a grouping genetic algorithm, evolved on islands with elite migration.

What fits together depends on lengths alone, so the search runs over the histogram of piece lengths: a chromosome
is a list of kinds of bins (the lengths in a bin, and how many such bins there are), whose size is bounded by the
capacity and does not grow with the number of documents. Documents are then dealt into the bins by their rank
among pieces of equal length.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, tidied, written
from .tokens import encoded

CAPACITY = 2048
#: kinds of bins: lengths of a bin in descending order -> number of such bins
Bins = dict[tuple[int, ...], int]


def best_fit(need: dict[int, int], capacity: int, bins: Bins | None = None, order: list[int] | None = None) -> Bins:
    """``bins`` with ``need`` (length -> pieces) placed best-fit, by default in descending order of length.

    Bins of one kind are handled together: a length goes to the open kind with the least room that still takes it,
    as often as it fits there, and new bins open where none does.
    """
    kinds: Bins = dict(bins or {})
    room: dict[int, list[tuple[int, ...]]] = {}
    for kind in kinds:
        room.setdefault(capacity - sum(kind), []).append(kind)
    rooms = sorted(room)
    for length in order or sorted(need, reverse=True):
        left = need.get(length, 0)
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                times = capacity // length
                full, rest = divmod(left, times)
                fresh = [((length,) * times, full)] * (full > 0) + [((length,) * rest, 1)] * (rest > 0)
                left = 0
            else:
                gap = rooms[at]
                kind = room[gap].pop()
                if not room[gap]:
                    del room[gap], rooms[at]
                count = kinds.pop(kind)
                times = gap // length
                full, rest = divmod(left, times)
                if full >= count:
                    fresh, left = [(kind + (length,) * times, count)], left - count * times
                else:
                    fresh = [(kind + (length,) * times, full)] * (full > 0) + [(kind + (length,) * rest, 1)] * (rest > 0) + [(kind, count - full - (rest > 0))]
                    fresh, left = [x for x in fresh if x[1]], 0
            for kind, count in fresh:
                kind = tuple(sorted(kind, reverse=True))
                if kind in kinds:
                    kinds[kind] += count
                    continue
                kinds[kind] = count
                gap = capacity - sum(kind)
                if gap not in room:
                    room[gap] = []
                    insort(rooms, gap)
                room[gap].append(kind)
    return kinds


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """(bins, less the mean squared fill): smaller is better."""
    n = sum(bins.values())
    return n, -sum(c * (sum(k) / capacity) ** 2 for k, c in bins.items()) / max(1, n)


def crossed(mother: Bins, father: Bins, counts: dict[int, int], capacity: int, random: np.random.Generator) -> Bins:
    """A child: whole well-filled bins of the father go in first, the mother's bins that hold none of their pieces next.

    Pieces that a removed bin of the mother leaves over are placed best-fit among what is there.
    """
    left = Counter(counts)
    child: Bins = {}

    def inject(kind: tuple[int, ...], most: int) -> None:
        own = Counter(kind)
        n = min([most, *(left[x] // k for x, k in own.items())])
        if n > 0:
            child[kind] = child.get(kind, 0) + n
            for x, k in own.items():
                left[x] -= n * k

    good = sorted(father, key=lambda k: (sum(k), len(k)), reverse=True)
    for kind in good[: max(1, int(len(good) * random.uniform(0.1, 0.6)))]:
        if capacity - sum(kind) <= capacity // 64 and random.random() < 0.7:
            inject(kind, father[kind])
    for kind in sorted(mother, key=lambda k: (sum(k), random.random()), reverse=True):
        if capacity - sum(kind) <= capacity // 16:
            inject(kind, mother[kind])
    return best_fit({x: n for x, n in left.items() if n > 0}, capacity, child)


def mutated(bins: Bins, capacity: int, random: np.random.Generator) -> Bins:
    """Empties the worst-filled kinds and a random share of the others, and places their pieces anew.

    Half of the time the other kinds lose only their pieces below a random length, which then fill what gaps there are.
    """
    kinds = sorted(bins, key=lambda k: sum(k))
    worst = 2 + int(random.integers(1, 8))
    share = random.choice((0.02, 0.1, 0.3, 0.5))
    small = int(capacity ** random.uniform(0.3, 0.9)) if random.random() < 0.5 else capacity
    left: Counter[int] = Counter()
    kept: Bins = {}
    for i, kind in enumerate(kinds):
        stays = kind
        if i < worst:
            stays = ()
        elif random.random() < (share if small == capacity else 0.9):
            stays = tuple(x for x in kind if x >= small)
        for x in kind[len(stays) :]:
            left[x] += bins[kind]
        if stays:
            kept[stays] = kept.get(stays, 0) + bins[kind]
    return best_fit(left, capacity, kept)


def start(counts: dict[int, int], capacity: int, random: np.random.Generator) -> Bins:
    """One random individual: best-fit in a disturbed descending order."""
    order = sorted(counts, key=lambda x: x * random.uniform(0.85, 1.15), reverse=True)
    return best_fit(counts, capacity, order=order)


def evolve(population: list[Bins], counts: dict[int, int], capacity: int, generations: int, size: int, random: np.random.Generator) -> tuple[list[Bins], int]:
    """(the best ``size`` different individuals, generations run); stops where no bin can be saved."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)

    def fittest(all_: list[Bins]) -> list[Bins]:
        return [b for _, b in sorted({fitness(b, capacity): b for b in all_}.items(), key=lambda x: x[0])][:size]

    population, run = fittest(population), 0
    while run < generations and sum(population[0].values()) > least:
        children = []
        for _ in range(size):
            a, b = (min(random.integers(0, len(population), 2)) for _ in range(2))
            child = crossed(population[a], population[b], counts, capacity, random)
            children.append(mutated(child, capacity, random) if random.random() < 0.7 else child)
        population, run = fittest([*population, *children]), run + 1
    return population, run


@dataclass
class Packing:
    """Kinds of bins, and how they were found: the lower bound, the fewest bins after each round, generations run by all islands."""

    bins: Bins
    least: int
    rounds: list[int]
    generations: int


def packed(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 6, rounds: int = 4, generations: int = 6, size: int = 6, elites: int = 2, seed: int = 1) -> Packing:
    """Bins that hold ``counts`` pieces of each length, evolved from random individuals on ``islands`` tasks.

    Between rounds the elites of each island move on to the next island in a ring. For the last round the plain
    best-fit individual joins the first island, so that the result never has more bins than that. No round follows
    one that has met the lower bound (all ids over the capacity). Every state is a row of a DataFrame, so a lost
    island is evolved again from the last round.
    """
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    if not counts:
        return Packing({}, 0, [], 0)
    shared = spark.sparkContext.broadcast(counts)

    def task(step: int):
        def work(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            random = np.random.default_rng([seed, step, island])
            own = [pickle.loads(x) for x in got["bins"] if x]
            if not own:
                own = [start(shared.value, capacity, random) for _ in range(size)]
            if step == rounds - 1 and not island:
                own.append(best_fit(shared.value, capacity))
            best, run = evolve(own, shared.value, capacity, generations, size, random)
            n, fit = zip(*(fitness(b, capacity) for b in best))
            return pd.DataFrame({"island": island, "rank": range(len(best)), "n": n, "fit": fit, "run": run, "bins": [pickle.dumps(b) for b in best]})

        return work

    schema = "island int, rank int, n long, fit double, run long, bins binary"
    state = spark.range(islands, numPartitions=1).select(F.col("id").cast("int").alias("island"), F.lit(None).cast("binary").alias("bins"))
    fewest, total = [], 0
    for step in range(rounds):
        evolved = written(state.repartition(islands, "island").groupBy("island").applyInPandas(task(step), schema), "islands")
        n, run = evolved.where("rank = 0").agg(F.min("n"), F.sum("run")).first()
        fewest, total = [*fewest, n], total + run
        if n <= least:
            break
        migrants = evolved.where(F.col("rank") < elites).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        state = evolved.union(migrants).select("island", "bins")
    shared.unpersist()
    return Packing(pickle.loads(bytes(evolved.orderBy("n", "fit", "island").select("bins").first()["bins"])), least, fewest, total)


def slots(bins: Bins) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: rows of (length, first rank, first bin, pieces per bin, offset), by length and rank."""
    rows, base = [], 0
    taken: Counter[int] = Counter()
    for kind, count in sorted(bins.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(kind).items(), reverse=True):
            rows.append((length, taken[length], base, per, offset))
            taken[length] += per * count
            offset += per * length
        base += count
    rows.sort()
    names = ("length", "rank", "base", "per", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (part, k): the k-th piece of this length in task ``part``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for row, tokens in encoded(vocabulary, (x.as_py() for x in batch.column("text"))):
                tokens += end
                for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    own = tokens[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((ids[row], piece, at // 4, length, zlib.crc32(own), part, int(met[length])))
                    met[length] += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, k long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and ``end_id``; one of more than ``capacity`` ids is cut into pieces of that many, the last
    one shorter. Null and empty texts are ``end_id`` alone. Repeated rows are packed as often as they occur, and a
    null doc_id is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        rows = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(slots(packed(spark, histogram, capacity).bins))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(earlier) - F.col("n")
    firsts = parts.select(F.col("length").alias("l"), F.col("part").alias("p"), before.alias("first"))
    ranked = rows.join(firsts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).drop("l", "p", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("k").to_numpy() + batch.column("first").to_numpy()
            lo, hi = np.searchsorted(own["length"], length), np.searchsorted(own["length"], length, "right")
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                a, b = int(lo[mine][0]), int(hi[mine][0])
                at[mine] = a + np.searchsorted(own["rank"][a:b], rank[mine], "right") - 1
            within = rank - own["rank"][at]
            sequence = own["base"][at] + within // own["per"][at]
            offset = own["offset"][at] + within % own["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(work), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens: the columns of op3_best_fit_packing.

    Nulls, repeated rows, an empty table and other columns are as in ``pack``.
    """
    return pack(docs, vocabulary_path())
