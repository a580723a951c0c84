"""Best-fit packing of documents into fixed-length training sequences.

Three steps: every text becomes pieces of at most ``capacity`` ids where it is read (a small table, written
once); the pieces are dealt out in a random but fixed order; each task packs its own stream online with a
fixed number of open bins.  A task's memory is those bins, however long its stream is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import tokens, words
from skerry.llm.storage import cut, lean

#: Bytes of a batch of texts: several slices of the encoder, so that few are cut short.
BATCH_BYTES = 16 << 20
#: Entries of each generation of the encoder's memory where packing runs alone; a worker of the pipeline holds fewer.
REMEMBERED_ALONE = 400_000
CAPACITY = 2048
OPEN_BINS = 512
#: Ids that one task packs; enough that the bins left open at its end hardly count.
IDS_PER_TASK = 1 << 24


class BestFit:
    """Bounded-space online best-fit.

    Open bins are kept by free space; bit ``f`` of ``free`` tells that some open bin has ``f`` left, so the
    tightest bin that fits and the fullest bin are each the lowest set bit of a shifted integer.  When more
    than ``open_bins`` are open, the fullest closes; a full bin closes at once.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.by_free, self.n_open, self.n_bins = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        found = self.by_free[space].pop()
        if not self.by_free[space]:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of that length."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.capacity, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.by_free[left].append(chosen)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
        return chosen, self.capacity - space


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_texts(path: str, capacity: int, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, encoder = 4 * capacity, tokens.ChunkEncoder(path, remembered)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            found = tokens.encode_all(batch.column(1), path, end_id, encoder)
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(
                        out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True
                    ):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        del encoder
        words.release()

    return run


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([base + b for b, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def text_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = 0,
    tokenizer: str = tokens.DEFAULT_FILE,
    remembered: int = tokens.REMEMBERED,
) -> DataFrame:
    """Pieces of every document's ids; only documents longer than ``capacity`` have more than one."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut_texts(tokenizer, capacity, end_id, remembered), PIECES
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = 0,
    tokenizer: str = tokens.DEFAULT_FILE,
    remembered: int = tokens.REMEMBERED,
) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    Null and empty texts are one piece, the end id alone.  Repeated rows are packed as often as they occur.
    Extra columns are not carried.  An empty table gives no rows.  ``remembered`` is the encoder's memory in a task; the
    rows do not depend on it.
    """
    lean(docs.sparkSession, BATCH_BYTES)
    pieces = cut(text_pieces(docs, capacity, end_id, tokenizer, remembered), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / IDS_PER_TASK))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        pieces.repartition(tasks, "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
        .mapInArrow(_pack(capacity, open_bins), PIECES + ", sequence_id long, offset long")
    )
