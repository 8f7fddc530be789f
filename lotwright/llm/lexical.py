"""Ranked lexical search: a two-level quantised index over segments of documents.

A segment holds the postings of some documents by term: ordinals, term frequencies (the exact level), and one byte for each
posting, its impact rounded upwards (the bound level). A search adds weighted bytes, which bounds every document's score
from above and below, and scores in exact integers only those whose upper bound reaches the k-th lower bound.
A segment is one row of a table, so tasks hold one at a time and no posting list has to fit a group.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, shared_path, small_batches, steps, table, text_bytes, words, written

#: Bytes of a term: digits, letters and all of UTF-8's characters outside ASCII.
INSIDE = np.zeros(256, bool)
for _from, _to in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    INSIDE[_from:_to] = True
#: Documents of a segment at most, besides ``common.STEP_BYTES`` of text; bytes of item texts that are searched for at once.
SEGMENT_DOCS, ITEM_BYTES = 2048, 256 << 10
#: What one unit of a byte impact stands for; a term's part of a score is under 1,000,000 before its weight.
UNIT = -(-1_000_000 // 255)

SEGMENT = "doc_ids array<bigint>, lengths binary, terms binary, ends binary, docs binary, tf binary, n_docs long, n_terms long"


def narrowed(values: np.ndarray) -> bytes:
    """values as bytes of the narrowest unsigned kind that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.empty(0, np.uint8)


def _segment(doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple:
    hashes, _, _, at = words(data, offsets, INSIDE, LOWER)
    lengths = np.diff(at)
    docs = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(hashes, kind="stable")  # ordinals stay ascending within a term
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    posting = fresh.copy()
    posting[1:] |= docs[1:] != docs[:-1]
    firsts = np.flatnonzero(posting)
    starts = np.flatnonzero(fresh[firsts])
    ends = np.append(starts[1:], len(firsts)) if len(firsts) else starts
    tf = np.diff(np.append(firsts, len(hashes)))
    return doc_ids, lengths.astype("<i8").tobytes(), hashes[firsts[starts]].tobytes(), ends.astype("<u4").tobytes(), narrowed(docs[firsts]), narrowed(tf), int((lengths > 0).sum()), len(hashes)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for a, b in steps(offsets):
            for i in range(a, b, SEGMENT_DOCS):
                j = min(b, i + SEGMENT_DOCS)
                row = _segment(ids[i:j], data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in SEGMENT.split(", ")])


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight, in exact integers."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a document's length weighs: 100 at the mean length, in exact integers."""
    return np.array([100 - 90 + 90 * int(x) * n // total for x in lengths], np.int64)


@dataclass
class Index:
    """Segments in the shared folder, documents with a term, and terms with repeats."""

    spark: SparkSession
    path: str
    n: int
    total: int

    def segments(self) -> DataFrame:
        return self.spark.read.schema(f"{SEGMENT}, impact binary").parquet(self.path)


def index(docs: DataFrame) -> Index:
    """Indexes the whole text of every row of docs (doc_id, text), each row a document of its own.

    Terms are runs of digits, letters and characters outside ASCII with A-Z lower-cased, known by a 64-bit hash. Null and
    empty texts have none. Byte impacts follow in a second pass over the postings, as they depend on the mean length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark, SEGMENT_DOCS):
        path = shared_path(spark, "postings")
        raw = written(rows.mapInArrow(_segments, SEGMENT), "postings", path)
    n, total = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            impact = []
            for k in range(batch.num_rows):
                ends = np.frombuffer(batch.column("ends")[k].as_py(), "<u4")
                postings = int(ends[-1]) if len(ends) else 0
                own = widened(batch.column("docs")[k].as_py(), postings)
                m = norms(np.frombuffer(batch.column("lengths")[k].as_py(), "<i8"), n, total)
                impact.append((-(-saturated(widened(batch.column("tf")[k].as_py(), postings), m[own]) // UNIT)).astype(np.uint8).tobytes() if postings else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(impact, pa.binary())], [*batch.schema.names, "impact"])

    own = shared_path(spark, "index")
    with small_batches(spark, 8):
        written(raw.where("n_docs > 0").mapInArrow(work, f"{SEGMENT}, impact binary"), "index", own)
    discard(spark, path)
    return Index(spark, own, n, total)


@dataclass
class Items:
    """Queries: ids, the distinct terms of each as numbers into ``terms`` (sorted hashes), and weights by term."""

    ids: list[int | None]
    own: list[np.ndarray]
    terms: np.ndarray
    weights: np.ndarray


def items_of(rows: list[tuple[int | None, str]]) -> Items:
    """Rows of one id, null included, are one item of all their terms; items without terms are left out."""
    texts: dict[int | None, list[str]] = {}
    for i, text in rows:
        texts.setdefault(i, []).append(text)
    hashes, _, _, at = words(*text_bytes(pa.array(["\n".join(x) for x in texts.values()], pa.string())), INSIDE, LOWER)
    terms = np.unique(hashes)
    own = [np.unique(np.searchsorted(terms, hashes[a:b])) for a, b in zip(at, at[1:])]
    kept = [k for k, x in enumerate(own) if len(x)]
    return Items([list(texts)[k] for k in kept], [own[k] for k in kept], terms, np.zeros(len(terms), np.int64))


def _frequencies(segments: DataFrame, shared) -> DataFrame:
    """term (its number) and df, a row for each term and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.terms
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                terms, ends = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(ends.as_py(), "<u4").astype(np.int64)
                at = np.searchsorted(terms, wanted)
                found = at < len(terms)
                found[found] = terms[at[found]] == wanted[found]
                df[found] += np.diff(ends, prepend=0)[at[found]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["term", "df"])

    return segments.select("terms", "ends").mapInArrow(work, "term long, df long")


class Searcher:
    """The k best of the segments that one task has seen, for every item."""

    def __init__(self, items: Items, k: int, n: int, total: int):
        self.items, self.k, self.n, self.total = items, k, n, total
        self.best: list[list[tuple]] = [[] for _ in items.ids]  # heaps of (score, less the id, id), the worst first
        self.bounds = np.zeros(len(items.ids), np.int64)  # the k-th lower bound so far, or 0
        self.rescored = 0

    def add(self, doc_ids: list, lengths: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> None:
        wanted, weights = self.items.terms, self.items.weights
        at = np.searchsorted(terms, wanted)
        found = at < len(terms)
        found[found] = terms[at[found]] == wanted[found]
        row = np.where(found, np.cumsum(found) - 1, -1)  # a term's row of the segment's matrix
        last = ends[at[found]].astype(np.int64)
        first = np.where(at[found] > 0, ends[at[found] - 1], 0).astype(np.int64)
        matrix = np.zeros((len(first), len(lengths)), np.uint8)
        if len(first):
            sizes = last - first
            flat = np.arange(int(sizes.sum())) + np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes)
            matrix[np.repeat(np.arange(len(first)), sizes), docs[flat]] = impact[flat]
        m = None
        for i, own in enumerate(self.items.own):
            own = own[found[own]]
            own = own[weights[own] > 0]
            if not len(own):
                continue
            heavy = weights[own].astype(np.float64)  # sums of whole numbers under 2**53: exact
            bytes_ = matrix[row[own]]
            above = (heavy @ bytes_).astype(np.int64) * UNIT
            there = np.flatnonzero((above > 0) & (above >= self.bounds[i]))
            if not len(there):
                continue
            mine = bytes_[:, there]
            below = above[there] - (heavy @ (mine > 0)).astype(np.int64) * (UNIT - 1)  # a byte b stands for more than (b - 1) units
            known = np.array([x[0] for x in self.best[i]], np.int64)
            lower = np.concatenate([below, known])
            if len(lower) >= self.k:
                self.bounds[i] = max(self.bounds[i], np.partition(lower, len(lower) - self.k)[len(lower) - self.k])
            chosen = there[above[there] >= self.bounds[i]]
            if m is None:
                m = norms(lengths, self.n, self.total)
            self._rescore(i, own, chosen, doc_ids, m, row, first, last, docs, tf)

    def _rescore(self, i: int, own: np.ndarray, chosen: np.ndarray, doc_ids: list, m: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> None:
        self.rescored += len(chosen)
        scores = np.zeros(len(chosen), np.int64)
        for t in own:
            a, b = first[row[t]], last[row[t]]
            at = np.minimum(np.searchsorted(docs[a:b], chosen), b - a - 1)
            hit = docs[a:b][at] == chosen
            scores[hit] += self.items.weights[t] * saturated(tf[a:b][at[hit]], m[chosen[hit]])
        best = self.best[i]
        for score, d in zip(scores.tolist(), chosen.tolist()):
            if score > 0:
                doc = doc_ids[d]
                entry = (score, doc is not None, -doc if doc is not None else 0, doc)  # ids ascending, null last
                if len(best) < self.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

    def rows(self) -> tuple[list, list, list]:
        found = [(item, x[3], x[0]) for item, best in zip(self.items.ids, self.best) for x in best]
        return tuple(zip(*found)) or ((), (), ())


def search(own: Index, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of every item's k best documents with a score above 0.

    ``benchmark`` has item_id and text; rows of one item_id, null included, are one item. Equal scores are by ascending
    doc_id, null last, and repeated documents take ranks of their own. Items are searched for in blocks of about
    ITEM_BYTES of text, each a pass over the index, so the driver and the tasks hold one block. Items without terms or
    without a document above 0 have no rows; an empty index or benchmark gives an empty result; other columns are ignored.
    """
    spark = own.spark
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    schema, n, total = "item_id long, doc_id long, score long", own.n, own.total

    def searched(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Searcher(shared.value, k, n, total)
            for batch in batches:
                for r in range(batch.num_rows):
                    cell = lambda name: batch.column(name)[r].as_py()  # noqa: B023, E731
                    ends = np.frombuffer(cell("ends"), "<u4")
                    postings = int(ends[-1])
                    found.add(cell("doc_ids"), np.frombuffer(cell("lengths"), "<i8"), np.frombuffer(cell("terms"), np.uint64), ends, widened(cell("docs"), postings), widened(cell("tf"), postings), np.frombuffer(cell("impact"), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found.rows()], ["item_id", "doc_id", "score"])

        return work

    results = []
    with small_batches(spark, 8):
        for block in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect() if n else []
            mine = items_of([(r["i"], r["t"]) for r in rows])
            shared = spark.sparkContext.broadcast(mine)
            df = {r["term"]: r["df"] for r in _frequencies(own.segments(), shared).groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the block's terms
            mine.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(mine.terms))], np.int64)
            shared.unpersist()
            shared = spark.sparkContext.broadcast(mine)
            results.append(written(own.segments().mapInArrow(searched(shared), schema), "found"))
            shared.unpersist()
    found = results[0]
    for x in results[1:]:
        found = found.union(x)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))  # k rows for each item and task
    return found.select("item_id", place.cast("int").alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``documents`` for each ``benchmark`` item."""
    own = index(table(spark, sf_dir, "documents"))
    return search(own, table(spark, sf_dir, "benchmark"))


#: The same rows by SQL, from all scores.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), p AS (
  SELECT r, doc_id, t, CAST(len(w) AS BIGINT) AS len, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL
), f AS (
  SELECT t, count(*) AS df FROM p GROUP BY t
), c AS (
  SELECT item_id, r, doc_id, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n) // l))) AS part
  FROM q JOIN f USING (t) JOIN p USING (t), s
), o AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM c GROUP BY item_id, r, doc_id HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM o
) WHERE rank <= 10
"""
