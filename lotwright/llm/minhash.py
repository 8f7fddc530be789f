"""Near-duplicate groups of documents: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, spread, steps, table, text_bytes, tidied, words, written
from .graph import components

#: Bytes of words: all but space and 0x09 to 0x0D.
INSIDE = np.ones(256, bool)
INSIDE[[32, *range(9, 14)]] = False
#: Signature values that one band holds.
ROWS = 4
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 16


def bands_for(percent: int, miss: float = 1e-6) -> int:
    """The least number of bands of ROWS values for which a pair at the threshold is missed with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text end to end, and len + 1 offsets.

    A text of fewer words than ``width`` has its whole sequence as one shingle, a text of none has no shingle.
    """
    hashes, _, _, at = words(data, offsets, INSIDE, LOWER)
    counts = np.diff(at)
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    short = (counts < width) & (counts > 0)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            rolled[: n - k] = mix(rolled[: n - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        runs[:] = rolled
        number = np.where(counts >= width, counts - width + 1, short.astype(np.int64))
        for i in np.flatnonzero(short):
            h = np.uint64(counts[i])
            for x in hashes[at[i] : at[i + 1]]:
                h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64))[0]
            runs[at[i]] = h ^ np.uint64(0xD1B54A32D192ED03)
    sets = [np.unique(runs[a : a + m]) for a, m in zip(at[:-1].tolist(), number.tolist())]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), cuts


def super_minhash(sets: np.ndarray, cuts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` float64 values for each set (rows of empty sets are inf).

    Element x at step j takes the next entry p of its own random permutation of 0..size-1 and offers j + u, u
    uniform in [0, 1), to place p; the ranks of one element are thus distinct over all places. A set stops as
    soon as no place holds a value of j + 1 or more, since later steps offer only larger ones.
    """
    out = np.full((len(cuts) - 1, size), np.inf)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    flat = out.reshape(-1)
    start = 0
    while start < len(sets):  # whole sets, about ELEMENTS elements at a time
        last = max(int(np.searchsorted(cuts, start + ELEMENTS, "right")) - 1, int(np.searchsorted(cuts, start, "right")))
        end = int(cuts[last])
        x, who = mix(sets[start:end] ^ np.uint64(seed)), owner[start:end]
        start = end
        places = None
        for j in range(size):
            z = mix(x + np.uint64(j * 0xA24BAED4963EE407 % (1 << 64)))
            u = (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            pick = j + (mix(z) % np.uint64(size - j)).astype(np.int64)
            if places is None:
                first, place = pick, pick
            else:
                row = np.arange(len(x))
                place = places[row, pick].astype(np.int64)
                places[row, pick] = places[row, j]
            np.minimum.at(flat, who * size + place, j + u)
            full = out[who[0] : who[-1] + 1].max(axis=1) < j + 1
            going = ~full[who - who[0]]
            if not going.any():
                break
            x, who = x[going], who[going]
            if places is None:
                places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(x), 1))
                first = first[going]
                row = np.arange(len(x))
                places[row, first] = 0  # step 0 swapped places 0 and first
            else:
                places = places[going]
    return out


def signed(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, h (64 bits of the text), n_shingles, fp (128 bits of the whole set; null without shingles), keys (a hash for each band), sig (16 bits of each value)."""
    size = bands * ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in steps(offsets):
                sets, cuts = shingle_sets(data, offsets[i : j + 1], width)
                values = super_minhash(sets, cuts, size).view(np.uint64)
                n = np.diff(cuts)
                keys = np.zeros((j - i, bands), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys * np.uint64(31) + values[:, k::ROWS])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                some, at = np.flatnonzero(n), cuts[:-1][n > 0]
                prints = np.zeros((j - i, 2), np.uint64)
                if len(some):
                    prints[some, 0] = np.add.reduceat(mix(sets ^ np.uint64(0x1234567)), at)
                    prints[some, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x89ABCDEF01)), at)
                raw = prints.tobytes()
                small = (mix(values) & np.uint64(0xFFFF)).astype("<u2")
                none = (n == 0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("h").slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array([None if x else raw[16 * k : 16 * k + 16] for k, x in enumerate(none)], pa.binary()),
                        pa.array([None if x else v for x, v in zip(none, keys.view(np.int64))], pa.list_(pa.int64())),
                        pa.array([None if x else v.tobytes() for x, v in zip(none, small)], pa.binary()),
                    ],
                    ["doc_id", "h", "n_shingles", "fp", "keys", "sig"],
                )

    return docs.mapInArrow(tidied(work), "doc_id long, h long, n_shingles long, fp binary, keys array<long>, sig binary")


def _links(width: int, percent: int):
    """Keeps pairs whose full shingle sets meet the threshold: 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, lo = text_bytes(batch.column("ta"))
            right, ro = text_bytes(batch.column("tb"))
            for i, j in steps(lo + ro):
                a, ac = shingle_sets(left, lo[i : j + 1], width)
                b, bc = shingle_sets(right, ro[i : j + 1], width)
                keep = np.zeros(j - i, bool)
                for k in range(j - i):
                    x, y = a[ac[k] : ac[k + 1]], b[bc[k] : bc[k + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return work


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles
    (words without white space, A-Z lower-cased).

    1. Documents of one and the same set form a class at once, whatever their number.
    2. Every class sends its band keys; within a key each class is paired with the key's smallest class only, so a
       key of n classes gives n - 1 pairs. The pairs are confirmed on full sets and grouped.
    3. Keys that still hold several groups: classes of different groups under such a key are compared by signature, in
       blocks of ``block`` rows that are dealt over the cluster; those that the signature does not exclude form
       clusters, of which only spanning edges are kept. Within a cluster all pairs of different groups are then compared
       on full sets, in blocks again, and spanning edges of their links are kept. Pairs inside one group change no
       component and are not looked at.

    Every link is confirmed on full sets (of 64-bit shingle hashes; sets of one class agree in a 128-bit sum of their
    hashes). What can be missed, by chance alone: a pair at the threshold that agrees in no band (10⁻⁶ at most), and
    one in step 3 that agrees in fewer signature values than five standard deviations under what is expected (under
    10⁻⁶). Similar texts usually have several ways to meet, so components lose less.

    Null and blank texts have no shingles and are linked with nothing. Repeated rows share one class and one
    component. Rows without doc_id take part in links; component_id is the smallest id of the rest, null if there
    is none, and such rows are never kept. Extra columns are ignored. An empty table gives an empty result.
    """
    bands = bands_for(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = written(signed(texts, width, bands), "signed")
    classes = written(
        rows.where("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h")).alias("row"), F.min_by("keys", "h").alias("keys"), F.min_by("sig", "h").alias("sig"))
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    keyed = classes.select("c", F.explode("keys").alias("key"))
    tops = keyed.groupBy("key").agg(F.min("c").alias("top"), F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(tops, "key").select("key", "c", "top"), "shared")
    pairs = shared.where("c <> top").select(F.col("c").alias("a"), F.col("top").alias("b")).distinct()

    def with_text(wanted: DataFrame) -> DataFrame:
        """(c, text) of the classes c: the text of the row that the class is named after."""
        of = classes.join(wanted, "c", "left_semi").select("c", F.col("row.doc_id").alias("of"), F.col("row.h").alias("h"))
        found = texts.join(of, (texts["h"] == of["h"]) & texts["doc_id"].eqNullSafe(of["of"]))
        return written(found.groupBy("c").agg(F.first("text").alias("text")), "texts")

    pairs = written(pairs, "pairs")
    wanted = with_text(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct())
    left, right = wanted.toDF("a", "ta"), wanted.toDF("b", "tb")
    links = written(pairs.join(left, "a").join(right, "b").mapInArrow(tidied(_links(width, percent)), "a long, b long"), "links")
    groups = components(links).select(F.col("vertex").alias("c"), F.col("component").alias("g"))
    size, t = bands * ROWS, percent / 100
    need = max(ROWS, math.floor(size * (t - 5 * math.sqrt(t * (1 - t) / size))))
    alike = written(_across(shared, classes, groups, need, block), "alike")
    if not alike.isEmpty():
        clusters = written(components(alike).select(F.col("vertex").alias("c"), F.col("component").alias("cluster")), "clusters")
        near = clusters.join(with_text(clusters.select("c")), "c").join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
        links = links.union(written(_within(near, width, percent), "more-links"))
        groups = components(links).select(F.col("vertex").alias("c"), F.col("component").alias("g"))
    named = classes.select("c", "fp", "doc_id").join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    least = named.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "g").select("fp", "component_id")
    out = rows.select("doc_id", "h", "n_shingles", "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("h").alias("text_hash"))


def _spanning(c: np.ndarray, first: np.ndarray, second: np.ndarray, joined: np.ndarray) -> pa.Table:
    """Edges (a, b), a > b, that span what the matrix ``joined`` (rows first, columns second, both into c) connects."""
    none = np.iinfo(np.int64).max
    label = c.copy()
    while joined.any():
        before = label.copy()
        np.minimum.at(label, second, np.where(joined, label[first][:, None], none).min(axis=0))
        np.minimum.at(label, first, np.where(joined, label[second][None, :], none).min(axis=1))
        if np.array_equal(before, label):
            break
    own = label != c
    return pa.table({"a": c[own], "b": label[own]})


def _across(shared: DataFrame, classes: DataFrame, groups: DataFrame, need: int, block: int) -> DataFrame:
    """(a, b): edges that span the classes of different groups with a common key and at least ``need`` equal signature values."""
    member = shared.select("key", "c").join(groups, "c", "left").select("key", "c", F.coalesce("g", "c").alias("g"))
    mixed = member.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key")
    member = member.join(mixed, "key")
    sizes = member.groupBy("key", "g").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "g")).alias("m"), F.sum("n").alias("all"))
    main = main.select("key", F.col("m.g").alias("main"), F.ceil(F.col("m.n") / block).alias("p"), F.ceil((F.col("all") - F.col("m.n")) / block).alias("q"))
    dealt = member.join(main, "key").join(classes.select("c", "sig"), "c")
    # the largest group of a key has p blocks and meets the q blocks of the others, which meet each other
    largest, last = F.col("g") == F.col("main"), F.col("p") + F.col("q") - 1
    own = F.when(largest, F.pmod(F.xxhash64("c"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("c"), "q"))
    other = F.explode(F.when(largest, F.sequence("p", last)).otherwise(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "g", "sig")

    def alike(got: pa.Table) -> pa.Table:
        own, c, g = (got[x].to_numpy() for x in ("own", "c", "g"))
        sig = np.frombuffer(b"".join(got["sig"].to_pylist()), "<u2").reshape(len(own), -1)
        first, second = (np.flatnonzero(own == got[k].to_numpy()) for k in "ij")
        same = np.zeros((len(first), len(second)), np.uint8 if sig.shape[1] < 256 else np.uint16)
        for k in range(sig.shape[1]):
            same += sig[first, k][:, None] == sig[second, k][None, :]
        return _spanning(c, first, second, (same >= need) & (g[first][:, None] != g[second][None, :]))

    return spread(dealt, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(alike, "a long, b long").distinct()


def _within(near: DataFrame, width: int, percent: int, rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """(a, b): edges that span the exact links between different groups of each cluster; near: c, cluster, g, text.

    A cluster is dealt as blocks of about ``rows`` texts or ``size`` bytes, and each pair of blocks is one group, whose
    intersections of full shingle sets are counted by products of incidence matrices.
    """
    blocks = near.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.octet_length("text").cast("long")) / size)).alias("p"))
    dealt = near.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("c"), "p"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "g", "text")

    def linked(got: pa.Table) -> pa.Table:
        own, c, g = (got[x].to_numpy() for x in ("own", "c", "g"))
        sets, cuts = shingle_sets(*text_bytes(got["text"]), width)
        first, second = (np.flatnonzero(own == got[k].to_numpy()) for k in "ij")
        owner = np.repeat(np.arange(len(own)), np.diff(cuts))
        order = np.argsort(sets, kind="stable")
        fresh = np.concatenate([[True], sets[order][1:] != sets[order][:-1]]) if len(sets) else np.empty(0, bool)
        shingle = np.cumsum(fresh) - 1
        often = np.bincount(shingle)[shingle] > 1 if len(sets) else fresh  # a shingle of one text is in no intersection
        shingle, owner = np.unique(shingle[often], return_inverse=True)[1], owner[order][often]
        both = np.zeros((len(own), len(own)), np.float32)
        step = 4096
        for lo in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, step):
            a, b = np.searchsorted(shingle, [lo, lo + step])
            present = np.zeros((len(own), step), np.float32)
            present[owner[a:b], shingle[a:b] - lo] = 1
            both += present @ present.T
        n = np.diff(cuts)
        common = np.rint(both[np.ix_(first, second)]).astype(np.int64)
        joined = 100 * common >= percent * (n[first][:, None] + n[second][None, :] - common)
        return _spanning(c, first, second, joined & (g[first][:, None] != g[second][None, :]))

    return spread(dealt, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(linked, "a long, b long").distinct()


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` at a Jaccard similarity of 0.85 over five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, one of each near-duplicate group (similarity 0.8, five words).

    Of a group the document with the smallest doc_id stays, once if its row repeats with the same text; documents
    without shingles and documents without doc_id all stay. Columns are kept as they are, whatever they are called; an
    empty table stays empty.
    """
    ids = written(near_duplicates(docs).where("doc_id IS NOT NULL AND n_shingles > 0"), "groups")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    named = lambda df: df.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    out = rows.join(named(ids.where("NOT kept")).distinct(), ["d", "h"], "left_anti")
    again = named(ids.where("kept")).groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():
        out = out.join(again, ["d", "h"], "left_anti").union(out.join(again, ["d", "h"], "left_semi").dropDuplicates(["d", "h"]))
    return out.select("row.*")
