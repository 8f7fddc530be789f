"""Sinks of their own: quoted text with a bare header, and keyed batches that are replaced as a whole or not at all.

Tasks write files that nobody reads yet, named by attempt; the commit makes those of the attempts that count visible, by renames.
After a failure the old state is untouched and the new files go, but for those of a task that outlives it, which nobody reads. Workers write with Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: rows of a batch at most.
BATCH = 100


def opened(path: str):
    """The file system of a path, and the path on it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _removed(fs, path: str) -> None:
    import pyarrow.fs as pafs

    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():05d}-{task.taskAttemptId()}"


@dataclass
class _Done(WriterCommitMessage):
    name: str
    keys: list[str]


def cell(value: object) -> str:
    """A quoted cell, quotes doubled; null is empty. Whole floating-point numbers have no fraction."""
    text = "" if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return '"' + text.replace('"', '""') + '"'


class _QuotedWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path, columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, path = opened(self.path)
        name = f"part-{_attempt()}.csv"
        fs.create_dir(f"{path}/_new-{self.job}")
        with fs.open_output_stream(f"{path}/_new-{self.job}/{name}") as out:
            out.write(",".join(self.columns).encode())
            for row in iterator:
                out.write(b"\r\n" + ",".join(map(cell, row)).encode())
        return _Done(name, [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        import pyarrow.fs as pafs

        fs, path = opened(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m:
                fs.move(f"{path}/_new-{self.job}/{m.name}", f"{path}/{m.name.removesuffix('.csv')}-{self.job}.csv")
        for one in old:
            fs.delete_file(one)
        _removed(fs, f"{path}/_new-{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        _removed(fs, f"{path}/_new-{self.job}")


class QuotedText(DataSource):
    """Text whose header is bare, whose cells are quoted and whose lines are parted by CRLF, none after the last; a file for each task."""

    @classmethod
    def name(cls) -> str:
        return "quoted_text"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _QuotedWriter(self.options["path"], schema.names, overwrite)


def write_quoted(rows: DataFrame, path: str) -> None:
    """rows as QuotedText below ``path``, in place of what was there. Null and empty cells are both two quotes."""
    rows.sparkSession.dataSource.register(QuotedText)
    rows.write.format("quoted_text").mode("overwrite").save(path)


class _BatchWriter(DataSourceWriter):
    def __init__(self, path: str, key: str, replace: bool):
        self.path, self.key, self.replace, self.job = path, key, replace, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, path = opened(self.path)
        own, chunks = _attempt(), {}
        rows = iter(iterator)
        waiting: dict[str, list[str]] = {}

        def flush(key: str) -> None:
            folder = f"{path}/key={key}/{self.job}/{own}"
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/{chunks.get(key, 0):06d}.json") as out:
                out.write("\n".join(waiting.pop(key)).encode())
            chunks[key] = chunks.get(key, 0) + 1

        while some := list(islice(rows, BATCH)):
            for row in some:
                fields = row.asDict(recursive=True)
                key = str(fields.pop(self.key))
                waiting.setdefault(key, []).append(json.dumps(fields, default=str))
                if len(waiting[key]) == BATCH:
                    flush(key)
            if len(waiting) > BATCH:  # rows are sorted by key, so these are done
                for key in list(waiting)[:-1]:
                    flush(key)
        for key in list(waiting):
            flush(key)
        return _Done(own, list(chunks))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        folders: dict[str, list[str]] = {}
        for m in messages:
            for key in m.keys if m else ():
                folders.setdefault(key, []).append(f"{self.job}/{m.name}")
        for key, new in folders.items():
            before = _current(fs, f"{path}/key={key}")
            with fs.open_output_stream(f"{path}/key={key}/next-{self.job}") as out:
                out.write(json.dumps(new if self.replace else before + new).encode())
            fs.move(f"{path}/key={key}/next-{self.job}", f"{path}/key={key}/current")
            for job in {x.split("/")[0] for x in before} if self.replace else ():
                _removed(fs, f"{path}/key={key}/{job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        import pyarrow.fs as pafs

        fs, path = opened(self.path)
        for folder in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            _removed(fs, f"{folder.path}/{self.job}")


def _current(fs, folder: str) -> list[str]:
    import pyarrow.fs as pafs

    if fs.get_file_info(f"{folder}/current").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{folder}/current") as file:
        return json.loads(file.readall())


class KeyedBatches(DataSource):
    """Rows of a key in files of at most BATCH; which files count is one small file for each key, replaced by a rename."""

    @classmethod
    def name(cls) -> str:
        return "keyed_batches"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options["path"], self.options["key"], overwrite)


def put_batches(rows: DataFrame, path: str, key: str, replace: bool = False) -> None:
    """Adds rows to the batches of their keys; with ``replace`` each key's rows take the place of what it had, the other keys stay.

    Keys are few and plain names (jobs); a key with many rows is written by many tasks.
    """
    rows.sparkSession.dataSource.register(KeyedBatches)
    rows.sortWithinPartitions(key).write.format("keyed_batches").option("key", key).mode("overwrite" if replace else "append").save(path)


def read_batches(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of all keys; ``schema`` has their columns without the key, which comes back as text."""
    import pyarrow.fs as pafs

    fs, local = opened(path)
    keys = [f.base_name for f in fs.get_file_info(pafs.FileSelector(local, allow_not_found=True)) if f.base_name.startswith("key=")]
    folders = [f"{path}/{k}/{x}" for k in keys for x in _current(fs, f"{local}/{k}")]
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("key", T.StringType())])
    if not folders:
        return spark.createDataFrame([], whole).withColumnRenamed("key", key)
    parts = spark.read.schema(T.StructType.fromDDL(schema)).json(folders).select("*", "_metadata.file_path")
    return parts.withColumn("key", F.regexp_extract("file_path", r"/key=([^/]*)/", 1)).drop("file_path").withColumnRenamed("key", key)
