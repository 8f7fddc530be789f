"""Token files: one array of ids per shard with Elias-Fano coded document boundaries and ids, written and read back.

A shard, from its start: magic, the ids end to end (16 or 32 bits each, little-endian), the coded sections, a fixed
footer that says where they begin, magic again. Readers need the footer and the part of the ids they want.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, table, tidied, written
from .tokens import encoded, encoder

MAGIC = b"LWTOKEN1"
#: Every so many set bits the place of one is kept, as 64 bits.
SAMPLE = 256
#: Numbers whose low bits are packed at once; a multiple of 8.
PACK = 1 << 15
#: Bytes of text (and some for each document) of a shard, and of one when there are fewer shards than shuffle partitions.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Documents that a reader decodes at once.
CHUNK = 4096


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers below a bound in about n * (2 + log2(bound / n)) bits.

    Low bits are stored as they are, high bits in unary; ``samples`` has the place of every SAMPLE-th set bit, so
    that the i-th number is found without reading the bits before it.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        bits = max(0, (bound // max(1, n)).bit_length() - 1)
        low = np.concatenate([np.empty(0, np.uint8), *(_packed(values[i : i + PACK], bits) for i in range(0, n, PACK))])
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little"), at[::SAMPLE].astype("<u8"))

    def select(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1."""
        j = min(j, self.n)
        if i >= j:
            return np.empty(0, np.int64)
        k = i // SAMPLE
        start = int(self.samples[k])
        stop = int(self.samples[-(-j // SAMPLE)]) if -(-j // SAMPLE) < len(self.samples) else len(self.high) * 8
        marks = np.unpackbits(self.high[start // 8 : stop // 8 + 1], bitorder="little")[start % 8 :]
        at = np.flatnonzero(marks)[i - k * SAMPLE : j - k * SAMPLE] + start
        high = (at - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first]
        low = bits.reshape(j - i, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)
        return (high | low.sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def raw(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: bytes) -> EliasFano:
        n, bits, low, high, samples = struct.unpack_from("<QQQQQ", raw)
        at = 40
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw, "<u8", samples, at + low + high))


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of each value, end to end."""
    return np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")


#: Of a shard's footer: bytes of an id, ids, documents, those with a null doc_id (first), least doc_id, and where the two coded sections begin.
FOOTER = struct.Struct("<QQQQqQQ8s")


def write_shard(out, rows: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Writes (doc_id, ids as 32-bit bytes) rows, null ids first and then ascending; returns documents and ids."""
    out.write(MAGIC)
    kind = f"<u{width}"
    starts, ids, nulls, total = array("Q"), array("q"), 0, 0
    for doc, raw in rows:
        own = np.frombuffer(raw, "<u4")
        out.write(own.astype(kind).tobytes())
        starts.append(total)
        total += len(own)
        if doc is None:
            nulls += 1
        else:
            ids.append(doc)
    documents = len(starts)
    starts.append(total)
    bounds = EliasFano.of(np.frombuffer(starts, np.uint64)).raw()
    least = ids[0] if ids else 0
    names = EliasFano.of(np.frombuffer(ids, np.int64).astype(np.uint64) - np.uint64(least % (1 << 64))).raw()  # modulo 2**64, as doc_ids may be negative
    at = len(MAGIC) + total * width
    out.write(bounds)
    out.write(names)
    out.write(FOOTER.pack(width, total, documents, nulls, least, at, at + len(bounds), MAGIC))
    return documents, total


class Shard:
    """A shard that is open for random reads."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = FOOTER.size
        self.width, self.total, self.documents, self.nulls, self.least, bounds, names, magic = FOOTER.unpack(file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds = EliasFano.read(file.read_at(names - bounds, bounds))
        self.names = EliasFano.read(file.read_at(size - tail - names, names))

    def chunk(self, i: int, j: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, the j - i + 1 boundaries, and the ids of documents i to j - 1."""
        bounds = self.bounds.select(i, j + 1)
        null = max(0, min(j, self.nulls) - i)
        names = (self.names.select(max(i, self.nulls) - self.nulls, max(0, j - self.nulls)) + self.least).tolist() if j > self.nulls else []
        raw = self.file.read_at(int(bounds[-1] - bounds[0]) * self.width, len(MAGIC) + int(bounds[0]) * self.width)
        return [None] * null + names, bounds, np.frombuffer(raw, f"<u{self.width}")


def _uri(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder as this library knows them: Hadoop's s3a and s3n are its s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write(docs: DataFrame, uri: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes docs (doc_id, text) as shards in ascending doc_id order; returns (part, path, documents, ids) of each, written as a table.

    Shards are range partitions of about SHARD_BYTES of text. Rows of equal doc_id follow each other, in order of a
    hash of the text. A file has the name of its attempt and nothing is renamed, so object stores will do: the
    returned table lists the files of the attempts that counted, and what others left behind is never read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, root = _opened(uri)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{part:07d}-{context.taskAttemptId()}.tok"
        width = 2 if max(encoder(vocabulary).vocabulary_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for i, tokens in encoded(vocabulary, (x.as_py() for x in batch.column("text"))):
                    yield ids[i], tokens + end

        with fs.open_output_stream(path) as out:
            documents, total = write_shard(out, rows(), width)
        if not documents:
            fs.delete_file(path)
            return
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "documents": [documents], "ids": [total]})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES)))
    rows = rows.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})  # ties are spread, too
    rows = rows.repartitionByRange(shards, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    with small_batches(spark):
        return written(rows.mapInArrow(tidied(work), "part int, path string, documents long, ids long"), "manifest")


def read(uri: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards (part, path, documents, ids)."""
    before = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")  # one row per shard
    rows = shards.select("path", before.alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(uri)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(path) as file:
                    shard = Shard(file)
                    i = 0
                    while i < shard.documents:
                        j = min(i + CHUNK, shard.documents)
                        while j > i + 1 and np.diff(shard.bounds.select(i, j + 1)[[0, -1]])[0] > 4 << 20:
                            j = i + (j - i) // 2
                        names, bounds, ids = shard.chunk(i, j)
                        wide = ids.astype("<u4")
                        cuts = bounds - bounds[0]
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    return rows.repartition(max(1, shards.count())).mapInArrow(tidied(work), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files say of each document.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. Null and empty
    texts are the end id alone; a text of any length is one document of one shard. Rows without doc_id come first;
    repeated rows are written as often as they occur. An empty table writes no file and gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    uri = _uri(spark, shared_path(spark, "tokens"))
    return read(uri, write(docs, uri, vocabulary, end_id))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole ``documents``, from the token files that they were written to."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
