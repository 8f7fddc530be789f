"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of benchmark words in whole documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, extended, mix, steps, table, text_bytes, tidied, words, written

#: Bytes of words: digits, letters, and all bytes of characters outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
#: Words of a window, words of a block in the shift table, words that one cursor scans.
WINDOW, BLOCK, SEGMENT = 10, 2, 256
#: Bytes of benchmark text that are searched for, and broadcast, at once.
PATTERN_BYTES = 2 << 20
#: Pairs of a position and a pattern of its suffix bucket that are compared at once.
CANDIDATES = 1 << 20


@dataclass
class WuManber:
    """Patterns of ``length`` words each: shift table, suffix buckets, first words and the pattern texts."""

    length: int
    shift: np.ndarray = field(default=None)
    suffixes: np.ndarray = field(default=None)  # sorted distinct suffix hashes
    bucket: np.ndarray = field(default=None)  # len + 1 offsets into the patterns
    hashes: np.ndarray = field(default=None)  # patterns x length word hashes
    texts: list[bytes] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, length: int, patterns: dict[bytes, tuple[np.ndarray, set[str]]]) -> WuManber:
        block = min(BLOCK, length)
        names = sorted(patterns)
        hashes = np.array([patterns[x][0] for x in names], np.uint64).reshape(-1, length)
        bits = max(12, min(22, int(np.ceil(np.log2(max(1, len(names)) * length * 8)))))
        shift = np.full(1 << bits, length - block + 1, np.uint8)
        for q in range(length - block, -1, -1):
            back = length - block - q
            at = (_blocks(hashes, np.full(len(names), q + block - 1), block) & np.uint64(len(shift) - 1)).astype(np.int64)
            np.minimum.at(shift, at, np.uint8(back))
        suffix = _blocks(hashes, np.full(len(names), length - 1), block)
        order = np.argsort(suffix, kind="stable")
        suffixes, first = np.unique(suffix[order], return_index=True)
        return cls(length, shift, suffixes, np.append(first, len(names)), hashes[order], [names[k] for k in order], [sorted(patterns[names[k]][1]) for k in order])

    def search(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every candidate whose word hashes agree; texts are runs of words between ``at``."""
        block = min(BLOCK, self.length)
        low, high = at[:-1] + self.length - 1, at[1:]
        number = np.maximum(0, -(-(high - low) // SEGMENT))
        which = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        here = np.repeat(low, number) + which * SEGMENT
        stop = np.minimum(here + SEGMENT, np.repeat(high, number))
        ends: list[np.ndarray] = []
        mask = np.uint64(len(self.shift) - 1)
        while len(here):
            step = self.shift[(_blocks(hashes[None], here, block) & mask).astype(np.int64)]
            ends.append(here[step == 0])
            here = here + np.maximum(step, 1)
            going = here < stop
            here, stop = here[going], stop[going]
        end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        if not len(end) or not len(self.suffixes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = _blocks(hashes[None], end, block)
        slot = np.minimum(np.searchsorted(self.suffixes, key), len(self.suffixes) - 1)
        end, slot = (x[self.suffixes[slot] == key] for x in (end, slot))
        size = self.bucket[slot + 1] - self.bucket[slot]
        firsts, patterns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in _runs(size, CANDIDATES):
            own = size[i:j]
            pattern = np.repeat(self.bucket[slot[i:j]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            first = np.repeat(end[i:j], own) - self.length + 1
            for k in range(self.length):
                same = hashes[first + k] == self.hashes[pattern, k]
                first, pattern = first[same], pattern[same]
            firsts.append(first)
            patterns.append(pattern)
        return np.concatenate(firsts), np.concatenate(patterns)


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to about ``most``, or of one element."""
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def _blocks(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` words that end at ``last``: of row i of a matrix at last[i], or of one row at all of them."""
    row = np.arange(len(hashes)) if len(hashes) == len(last) and hashes.shape[0] > 1 else np.zeros(len(last), np.int64)
    if block == 1:
        return mix(hashes[row, last])
    return mix(hashes[row, last - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[row, last])


def compiled(items: list[tuple[str | None, str]]) -> list[WuManber]:
    """Matchers for the windows of the items, one for each length of windows that occurs."""
    data, offsets = text_bytes(pa.array([text for _, text in items], pa.string()))
    hashes, starts, ends, at = words(data, offsets, INSIDE, LOWER)
    low = LOWER[data].tobytes()
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = defaultdict(dict)
    for (item, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist()):
        n = min(WINDOW, b - a)
        for k in range(a, b - n + 1) if n else ():
            text = b" ".join([low[starts[w] : ends[w]] for w in range(k, k + n)])
            found[n].setdefault(text, (hashes[k : k + n], set()))[1].update(() if item is None else (item,))
    return [WuManber.of(n, patterns) for n, patterns in sorted(found.items())]


def _found(own: list[WuManber], texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[set[str]]]]:
    """(i, j, boundaries of texts i to j - 1 in words, whether each word is hit, items found in each text)."""
    data, offsets = text_bytes(texts)
    for i, j in steps(offsets):
        hashes, starts, ends, at = words(data, offsets[i : j + 1], INSIDE, LOWER)
        hit = np.zeros(len(hashes) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(j - i)]
        for matcher in own:
            first, pattern = matcher.search(hashes, at)
            document = np.searchsorted(at, first, "right") - 1
            for d, w, p in zip(document.tolist(), first.tolist(), pattern.tolist()):
                text = b" ".join([LOWER[data[a:b]].tobytes() for a, b in zip(starts[w : w + matcher.length], ends[w : w + matcher.length])])
                if text == matcher.texts[p]:
                    hit[w] += 1
                    hit[w + matcher.length] -= 1
                    items[d].update(matcher.items[p])
        yield i, j, at, np.cumsum(hit[:-1]) > 0, items


def _sha(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
TAIL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _whole(matchers, keep: list[str]):
    """mapInArrow function for a benchmark of one block: each row's result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, marked, items in _found(matchers.value, batch.column("_text")):
                total = np.concatenate([[0], np.cumsum(marked)])
                n_hit = total[at[1:]] - total[at[:-1]]
                columns = [pa.array(np.diff(at)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_sha(x) for x in items]), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), *columns], [*keep, *COLUMNS])

    return work


def _part(matchers):
    """mapInArrow function for one block of a larger benchmark: hit spans (pairs of word numbers) and items of the rows with hits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, marked, items in _found(matchers.value, batch.column("_text")):
                rows = np.unique(np.searchsorted(at, np.flatnonzero(marked), "right") - 1)
                spans = [np.flatnonzero(np.diff(np.concatenate([[0], marked[at[d] : at[d + 1]].astype(np.int8), [0]]))).tolist() for d in rows]
                ids = batch.column("_row").slice(i, j - i).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(items[d]) for d in rows], pa.list_(pa.string()))], ["_row", "_spans", "_items"])

    return work


def _joined(keep: list[str]):
    """mapInArrow function: each row's result from its spans and items of all blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, found = [], []
            for spans, items in zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()):
                ends = sorted((a, b) for own in spans or () for a, b in zip(own[::2], own[1::2]))
                n = reached = 0
                for a, b in ends:
                    n += max(0, b - max(a, reached))
                    reached = max(reached, b)
                n_hit.append(n)
                found.append({x for own in items or () for x in own})
            columns = [batch.column("_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_sha(x) for x in found]), pa.array([n > 0 for n in n_hit])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *COLUMNS])

    return work


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], nameless: bool = False) -> DataFrame:
    """The columns ``keep`` of docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is a run of digits, letters and characters outside ASCII, A-Z lower-cased. A window is 10 consecutive
    words of an item, or all of an item of fewer; every document word inside an occurrence of a window is hit.
    The benchmark is searched for in blocks of about PATTERN_BYTES of its text, each compiled on the driver and
    broadcast. One block is run over the documents as they are read. For more, the documents are written once with a
    number for each row, every block is a pass of its own over them that leaves the rows with hits only, and these are
    joined by number at the end: a task never runs more than one search, however large the benchmark.

    Null and blank texts have no words and no hits; a text of any length is searched whole. Items
    without text or words find nothing; those without id only if ``nameless``, and then their words count in n_hit and
    contaminated, not in n_items and items_sha256. Several rows of one item_id count as one item. An empty benchmark
    gives no hits. Repeated documents get equal rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL")
    if not nameless:
        items = items.where("i IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // PATTERN_BYTES))
    schema = extended(docs.select(*keep), TAIL)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def matchers(k: int):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).distinct().collect()
        return spark.sparkContext.broadcast(compiled([(r["i"], r["t"]) for r in own]))

    if blocks == 1:
        return rows.mapInArrow(tidied(_whole(matchers(0), keep)), schema)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = None
    for k in range(blocks):
        shared = matchers(k)
        part = written(rows.select("_row", "_text").mapInArrow(tidied(_part(shared)), "_row long, _spans array<bigint>, _items array<string>"), "hits")
        shared.unpersist()
        found = part if found is None else found.union(part)
    found = found.groupBy("_row").agg(F.collect_list("_spans").alias("_spans"), F.collect_list("_items").alias("_items"))  # one row a block at most
    text = F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    joined = rows.select(*keep, "_row", n_words.alias("_words")).join(found, "_row", "left").select(*keep, "_words", "_spans", "_items")
    return joined.mapInArrow(tidied(_joined(keep)), schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in whole ``documents``, of items without id too."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], nameless=True)


#: The same rows by SQL: windows of each length that occurs, joined with the documents' runs of as many words.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS i,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT i, n, array_to_string(w[k : k + n - 1], ' ') AS t
  FROM (SELECT i, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), f AS (
  SELECT r, k, s.n, i FROM s JOIN p ON s.n = p.n AND s.t = p.t
), h AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM f) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i FROM f WHERE i IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark window occurs.

    Documents of null or blank text stay; repeated rows stay repeated; columns are kept as they are, whatever they are
    called; an empty benchmark keeps all documents, and an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the columns are called
    return search(rows, table(spark, sf_dir, "benchmark"), ["row"], nameless=True).where(~F.col("contaminated")).select("row.*")
