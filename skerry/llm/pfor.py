"""Token ids in patched frame-of-reference files, written in ascending ``doc_id`` order.

A block of ids keeps its minimum and packs the differences at the width that a percentile of them needs; the
few wider ones leave their high bits in an exception list.  Each file holds whole documents, a table of their
lengths, and an index of where every block starts; ``File`` decodes any block or document alone through it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm import tokens, words
from skerry.llm.storage import cut, lean, new_path, uri

MAGIC = b"PFOR0001"
#: Bytes of a batch of texts: several slices of the encoder, so that few are cut short.
BATCH_BYTES = 16 << 20
#: Entries of each generation of the encoder's memory: this runs alone, so a worker may hold more than in the pipeline.
REMEMBERED = 400_000
BLOCK = 1024
LANES = 16
ROWS = BLOCK // LANES
PERCENTILE = 0.95
#: Ids after which a file is closed (at the end of a document).
IDS_PER_FILE = 1 << 20
HEADER = struct.Struct("<8sQQQQQ")  # magic, documents, ids, blocks, packed words, exceptions


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


@dataclass
class Blocks:
    """Encoded ids: per block its minimum, width, first packed word and first exception."""

    n: int
    least: np.ndarray
    width: np.ndarray
    first_exception: np.ndarray
    words: np.ndarray
    where: np.ndarray
    high: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.width.astype(np.uint64) * LANES))).astype(np.uint64)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> Blocks:
    """``ids``: unsigned 32-bit.  The last block is filled up with its last id; ``n`` tells where it ends."""
    n, count = len(ids), -(-len(ids) // BLOCK)
    if not n:
        none = np.zeros(0, np.uint32)
        return Blocks(0, none, none.astype(np.uint8), np.zeros(1, np.uint64), none.astype(np.uint64), none, none)
    full = np.full(count * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(count, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    at = int(percentile * (BLOCK - 1))
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    high = rest >> width[:, None].astype(np.uint32)
    block, where = np.nonzero(high)
    first = np.concatenate(([0], np.cumsum(np.bincount(block, minlength=count)))).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * LANES)))
    words = np.zeros(starts[-1], np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        low = (rest[own] & np.uint32((1 << int(w)) - 1)).astype(np.uint64).reshape(len(own), ROWS, LANES)
        packed = np.zeros((len(own), int(w), LANES), np.uint64)
        for i in range(ROWS):
            word, shift = divmod(i * int(w), 64)
            packed[:, word] |= low[:, i] << np.uint64(shift)
            if shift + int(w) > 64:
                packed[:, word + 1] |= low[:, i] >> np.uint64(64 - shift)
        words[(starts[own][:, None] + np.arange(int(w) * LANES)).ravel()] = packed.ravel()
    return Blocks(n, least, width, first, words, where.astype(np.uint32), high[block, where])


def decode_blocks(b: Blocks) -> np.ndarray:
    """The ids again."""
    count = len(b.least)
    out = np.zeros((count, BLOCK), np.uint32)
    starts = b.starts.astype(np.int64)
    for w in np.unique(b.width[b.width > 0]):
        own = np.flatnonzero(b.width == w)
        packed = b.words[(starts[own][:, None] + np.arange(int(w) * LANES)).ravel()].reshape(len(own), int(w), LANES)
        low = np.empty((len(own), ROWS, LANES), np.uint32)
        cover = np.uint64((1 << int(w)) - 1)
        for i in range(ROWS):
            word, shift = divmod(i * int(w), 64)
            value = packed[:, word] >> np.uint64(shift)
            if shift + int(w) > 64:
                value |= packed[:, word + 1] << np.uint64(64 - shift)
            low[:, i] = value & cover
        out[own] = low.reshape(len(own), BLOCK)
    block = np.repeat(np.arange(count), np.diff(b.first_exception.astype(np.int64)))
    out[block, b.where] |= b.high << b.width[block].astype(np.uint32)
    out += b.least[:, None]
    return out.reshape(-1)[: b.n]


def write_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The image of one file."""
    b = encode_blocks(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = (
        np.array([d or 0 for d in doc_ids], np.int64),
        known,
        np.array(lengths, np.int64),
        b.starts,
        b.first_exception,
        b.least,
        b.width,
        b.words,
        b.where.astype(np.uint16),
        b.high,
    )
    head = HEADER.pack(MAGIC, len(doc_ids), b.n, len(b.least), len(b.words), len(b.where))
    return head + b"".join(p.tobytes() for p in parts)


def read_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of one file."""
    magic, docs, n, blocks, words, exceptions = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    at = HEADER.size

    def part(kind, size):
        nonlocal at
        found = np.frombuffer(data, kind, size, at)
        at += found.nbytes
        return found

    doc_ids, known, lengths = part(np.int64, docs), part(np.uint8, docs), part(np.int64, docs)
    part(np.uint64, blocks + 1)
    first, least, width = part(np.uint64, blocks + 1), part(np.uint32, blocks), part(np.uint8, blocks)
    packed, where, high = part(np.uint64, words), part(np.uint16, exceptions), part(np.uint32, exceptions)
    ids = decode_blocks(Blocks(n, least, width, first, packed, where, high))
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, ids


class File:
    """One file, read in pieces: the tables of documents and blocks, then only the blocks that are asked for.

    ``source`` is a seekable binary file.
    """

    def __init__(self, source):
        self.source = source
        source.seek(0)
        magic, docs, self.n, blocks, self.words, self.exceptions = HEADER.unpack(source.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = HEADER.size

        def part(kind, size: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(source.read(np.dtype(kind).itemsize * size), kind)
            at += found.nbytes
            return found

        doc_ids, known, self.lengths = part(np.int64, docs), part(np.uint8, docs), part(np.int64, docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.starts, self.first = part(np.uint64, blocks + 1).astype(np.int64), part(np.uint64, blocks + 1).astype(np.int64)
        self.least, self.width = part(np.uint32, blocks), part(np.uint8, blocks)
        self.packed_at = at
        self.where_at = at + 8 * self.words
        self.high_at = self.where_at + 2 * self.exceptions
        self.ends = np.cumsum(self.lengths)

    def _piece(self, kind, at: int, a: int, b: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        self.source.seek(at + size * a)
        return np.frombuffer(self.source.read(size * (b - a)), kind)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks ``a`` to ``b - 1``: three reads, where the index says."""
        x, y = int(self.first[a]), int(self.first[b])
        return decode_blocks(
            Blocks(
                min(self.n, b * BLOCK) - a * BLOCK,
                self.least[a:b],
                self.width[a:b],
                self.first[a : b + 1] - x,
                self._piece(np.uint64, self.packed_at, int(self.starts[a]), int(self.starts[b])),
                self._piece(np.uint16, self.where_at, x, y),
                self._piece(np.uint32, self.high_at, x, y),
            )
        )

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's document number ``i``, from the blocks that hold them."""
        end = int(self.ends[i])
        start = end - int(self.lengths[i])
        if start == end:
            return np.zeros(0, np.uint32)
        a = start // BLOCK
        return self.blocks(a, -(-end // BLOCK))[start - a * BLOCK : end - a * BLOCK]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, _ = fs.FileSystem.from_uri(row["store"])
            with store.open_input_file(row["path"]) as f:
                doc_ids = File(f).doc_ids
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([row["store"]] * n), pa.array([row["path"]] * n), pa.array(range(n), pa.int64())],
                names=["doc_id", "store", "path", "place"],
            )


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, _ = fs.FileSystem.from_uri(row["store"])
            with store.open_input_file(row["path"]) as f:
                file = File(f)
                found = [(file.doc_ids[i], file.document(i).tolist()) for i in sorted(row["places"])]
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def find_ids(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted`` (``doc_id``), each as often as it was written; null ids aren't found.

    The files' tables of documents are joined with what is wanted; then only the blocks of those documents are read.
    """
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    listed = manifest.select("store", "path").mapInArrow(_listed, "doc_id long, store string, path string, place long")
    files = listed.join(asked, "doc_id").groupBy("store", "path").agg(F.collect_list("place").alias("places"))  # of one file
    return files.mapInArrow(_finder, "doc_id long, ids array<long>")


MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size, files = 0, 0
        encoder = tokens.ChunkEncoder(tokenizer, REMEMBERED)

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, held, size, files
            name = f"{root}/ids-{part:06d}-{files:06d}.pfor"
            image = write_bytes(doc_ids, [len(h) // 4 for h in held], np.frombuffer(b"".join(held), np.uint32))
            with store.open_output_stream(f"{name}.{attempt}") as out:
                out.write(image)
            store.move(f"{name}.{attempt}", name)  # a second attempt writes the same file
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "file": files, "path": name, "n_docs": len(doc_ids), "n_tokens": size}],
                schema=pa.schema(
                    [
                        ("part", pa.int32()),
                        ("file", pa.int32()),
                        ("path", pa.string()),
                        ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()),
                    ]
                ),
            )
            doc_ids, held, size, files = [], [], 0, files + 1
            return row

        for batch in batches:
            found = tokens.encode_all(batch.column(1), tokenizer, end_id, encoder)
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= IDS_PER_FILE:
                    yield close()
        if doc_ids:
            yield close()
        del encoder
        words.release()

    return run


def write_ids(
    docs: DataFrame, folder: str | None = None, end_id: int = 1, tokenizer: str = tokens.DEFAULT_FILE
) -> DataFrame:
    """Write the ids of every text (null: empty), each with the end id, and return the manifest of the files.

    Rows are dealt out by ranges of ``doc_id`` (null first, ties by the text's hash), so files in the order
    (part, file) hold ascending ids.  A task holds one file's ids at a time.  Files are written under another
    name and renamed; a task that runs again replaces them by the same bytes.
    """
    spark = docs.sparkSession
    lean(spark, BATCH_BYTES)
    folder = uri(folder or new_path(spark, "pfor"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    tie = F.xxhash64("text")
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
    )
    return cut(
        dealt.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).withColumn("store", F.lit(folder)), "manifest"
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, _ = fs.FileSystem.from_uri(row["store"])
            with store.open_input_stream(row["path"]) as f:
                doc_ids, lengths, ids = read_bytes(f.read())
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths + row["start"], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: the ids before it in the whole corpus, its length and its checksum.

    Totals are summed up per part first (as many rows as write tasks), then inside each part.
    """
    order = Window.orderBy("part")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    files = (
        manifest.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .join(parts, "part")
        .select("store", "path", (F.col("before") + F.col("own")).alias("start"))
    )
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
