"""Ordered, idempotent output: a topic is a folder of data files and a log of manifests.

A write is a Spark job through a Python data source.  Every task writes one file of its rows; the driver gets the tasks'
messages and publishes them all by one manifest, created under a name that may exist once only: the batch's.  Whoever comes
second (a replay, or another writer) finds the name taken and takes its files away again.  Readers see what manifests name,
so a batch is there whole or not at all.  Rows of a key are in one file of the batch, in their order.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "skerry_topic"
#: File systems where a rename onto a file that exists fails.
RENAMES = ("hdfs", "viewfs")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def create_only(path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of that name; whether it was written."""
    store, name = _store(path)
    store.create_dir(name.rsplit("/", 1)[0])
    own = f"{name}.{uuid.uuid4().hex}.tmp"
    if not isinstance(store, fs.LocalFileSystem) and store.type_name not in RENAMES:
        raise ValueError(f"no create-only writes to {store.type_name}")
    with store.open_output_stream(own) as out:
        out.write(text.encode())
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(own, name)
        else:
            store.move(own, name)
        return True
    except OSError:
        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
        return False
    finally:
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_file(own)


def _manifests(path: str) -> list[str]:
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def _read(path: str, name: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/_log/{name}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Files:
    """What batch and stream writers share."""

    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer") or uuid.uuid4().hex
        self.manifest = options.get("manifest")
        self.order = [c for c in options.get("order", "").split(",") if c]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, root = _store(self.path)
        name, out, rows = f"{self.writer}-{context.partitionId():06d}-{context.taskAttemptId()}.parquet", None, 0
        for batch in self.batches(iterator):
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{root}/data")
                out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return iterator

    def publish(self, messages: list, name: str) -> None:
        files = [m.file for m in messages if m and m.file]
        body = {"writer": self.writer, "files": files, "rows": sum(m.rows for m in messages if m)}
        if not create_only(f"{self.path}/_log/{name}.json", json.dumps(body)):
            self.discard(messages)

    def discard(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/data/{m.file}")


class TopicWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.manifest)

    def abort(self, messages: list) -> None:
        self.discard(messages)


class TopicStreamWriter(_Files, DataSourceStreamArrowWriter):
    """Rows of a task are put in order in memory, as a stream's plan can't sort: for small micro-batches; ``each_batch``
    lets Spark sort.
    """

    def batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not self.order:
            yield from iterator
            return
        held = list(iterator)
        if held:
            yield from pa.Table.from_batches(held).sort_by([(c, "ascending") for c in self.order]).to_batches()

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"{batchId:020d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.discard(messages)


class Topic(DataSource):
    """``path``: the topic; ``manifest``: the batch's name (streams: their batch id); ``order``: columns, for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TopicWriter:
        return TopicWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicStreamWriter:  # noqa: N802
        return TopicStreamWriter(dict(self.options))


_known: set[str] = set()
_lock = threading.Lock()


def register(spark: SparkSession) -> None:
    """Make the format known to a session, once: to register it again takes it away for a moment.

    Formats are looked up in the thread's active session, which a thread of its own has none of.
    """
    session = spark._jsparkSession.sessionUUID()
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    with _lock:
        if session not in _known:
            spark.dataSource.register(Topic)
            _known.add(session)


def _named(batch: int | str) -> str:
    if isinstance(batch, int):
        return f"{batch:020d}"
    if not batch or "/" in batch or batch.startswith("."):
        raise ValueError(f"not a name for a batch: {batch!r}")
    return batch


def publish(rows: DataFrame, path: str, batch: int | str, key: str | None = None, order: tuple[str, ...] = ()) -> bool:
    """Add a batch to the topic, with ``key`` in the order of ``order`` (null first) inside each key, numbered from 0 as
    ``place``; whether it was added: a batch of a name that is there already adds nothing.

    Rows of a key pass through one task in their order, spilling as they are sorted; without a key they stay where they are.
    An empty batch is a manifest without files.
    """
    name, writer = _named(batch), uuid.uuid4().hex
    if f"{name}.json" in _manifests(path):
        return False
    if key:
        by = [F.col(c).asc_nulls_first() for c in order]
        w = Window.partitionBy(key).orderBy(*(by or [F.lit(0)]))
        rows = rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    register(rows.sparkSession)
    rows.write.format(FORMAT).mode("append").options(path=path, manifest=name, writer=writer).save()
    return _read(path, f"{name}.json")["writer"] == writer


def each_batch(path: str, key: str | None = None, order: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every micro-batch under its id, so that a replayed one adds nothing."""
    return lambda rows, batch: publish(rows, path, batch, key, order) and None


def files(path: str) -> list[str]:
    """The data files that manifests name, batch by batch."""
    return [f"{path}/data/{f}" for name in _manifests(path) for f in _read(path, name)["files"]]


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What has been published to a topic."""
    found = files(path)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def append_absent(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Create-only rows: those whose key no row of the topic has are added, in one batch; how many attempts it took.

    The one with the least other columns stands for rows of one key.  Every batch has the next number as its name; a writer
    that finds it taken looks again at what is there, so of two that race with a key one adds it.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(*others) if others else F.lit(0)).alias("_first")
    first = rows.groupBy(*keys).agg(least).select(*keys, *(["_first.*"] if others else [])).select(*rows.columns)
    attempt = 0
    while True:
        attempt += 1
        known = _manifests(path)
        held = read(spark, path, first.schema)
        new = first.join(held.select(*keys), keys, "left_anti") if known else first
        if publish(new.select(*rows.columns), path, len(known)):
            return attempt
