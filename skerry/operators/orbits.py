"""Sessions bounded by length, and sets with a time to live, of keys of any size.

Both are one rule on the sorted times of a key: after a start at time x the next start is the first row whose time is x +
``span`` or more, or that comes ``gap`` or more after the row before it.  The next start of every row is found by binary
search, the starts that are reached by pointer doubling, all in numpy.

A key is no unit of work.  Where one has more than ``ALONE`` rows, rows are dealt out to ranges of (key, time), and a key that
begins in a range is followed there.  What a range begins with may go on from the range before, so it is cut in blocks whose transition maps (the start that is
open before a block -> the one that is open after it, and the starts between) are composed in a tree of ``FAN`` branches; the
starts that come down that tree open each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skerry.sources import scratch

#: Rows of a key that a task follows alone, rows of a block, and blocks whose maps are composed in one task.
ALONE, BLOCK, FAN = 1 << 20, 1 << 14, 64
FAR = 1 << 62
FRESH = -FAR  # the open start where none is


def _next(t: np.ndarray, segment: np.ndarray, span: int, gap: int) -> np.ndarray:
    """The row of the next start after a start at each row, ``len(t)`` beyond the row's segment (ascending numbers)."""
    n = len(t)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    low = np.repeat(t[first], np.diff(np.r_[first, n]))
    reach = int((t - low).max()) + min(span, FAR >> 20) + 1 if n else 1
    if span < FAR >> 20 and reach * len(first) < FAR:  # all segments in one ascending row of numbers
        at = t - low + segment * reach
        later = np.searchsorted(at, at + span, "left")
    else:
        later = np.concatenate([a + np.searchsorted(t[a:b], np.minimum(t[a:b], FAR - span) + span, "left") for a, b in zip(first, np.r_[first[1:], n], strict=True)])
    broken = np.r_[False, (t[1:] - t[:-1] >= gap) & (segment[1:] == segment[:-1])]
    after = np.where(broken, np.arange(n), n)
    after = np.minimum.accumulate(np.r_[after, n][::-1])[::-1][1:]  # the first break after each row
    found = np.minimum(np.maximum(later, np.arange(n) + 1), after)
    return np.where(found < end, found, n)


def _reached(following: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which rows the seeds lead to, with themselves."""
    n = len(following)
    jumps, step = [], np.r_[following, n]
    while (step[:-1] < n).any():
        jumps.append(step)
        step = step[step]
    hit = np.zeros(n + 1, bool)
    hit[seeds] = True
    for jump in reversed(jumps):
        hit[jump[np.flatnonzero(hit)]] = True
    return hit[:-1]


def _last(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the last start that each row leads to, how many starts there are up to it with both)."""
    n = len(following)
    step, last, count = np.r_[following, n], np.arange(n + 1), np.r_[np.ones(n, np.int64), 0]
    while (step[:-1] < n).any():
        last = np.where(step < n, last[np.minimum(step, n)], last)
        count = count + count[step]
        step = step[step]
    return last[:-1], count[:-1]


class Map:
    """What a run of rows does to the open start x: the first of ``at`` (times, ascending) that is x + span or more, or the
    last if ``forced``, says which start is open afterwards (``out``) and how many starts there were (``count``); without
    one x stays open.
    """

    def __init__(self, at: np.ndarray, out: np.ndarray, count: np.ndarray, forced: bool):
        self.at, self.out, self.count, self.forced = at, out, count, forced

    @classmethod
    def of(cls, t: np.ndarray, before: int, span: int, gap: int) -> Map:
        """The map of one block; ``before`` is the time of the row before it, ``FRESH`` for none."""
        following = _next(t, np.zeros(len(t), np.int64), span, gap)
        last, count = _last(following)
        breaks = np.flatnonzero(t - np.r_[before, t[:-1]] >= gap) if before != FRESH else np.zeros(1, np.int64)
        # no start is open that is more than a span before the last row
        late = np.flatnonzero(t - span >= before) if before != FRESH else breaks
        ends = [int(x[0]) for x in (breaks, late) if len(x)]
        n = min(ends) + 1 if ends else len(t)
        return cls(t[:n], t[last[:n]], count[:n], bool(ends))._short()

    def _short(self) -> Map:
        """Without entries that say the same as the next one."""
        keep = np.r_[(self.out[1:] != self.out[:-1]) | (self.count[1:] != self.count[:-1]), True][: len(self.at)]
        return Map(self.at[keep], self.out[keep], self.count[keep], self.forced)

    def apply(self, x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(open start afterwards, starts between) of open starts."""
        if not len(self.at):
            return x, np.zeros(len(x), np.int64)
        j = np.searchsorted(self.at, np.where(x == FRESH, FRESH, np.minimum(x, FAR - span) + span), "left")
        hit = (j < len(self.at)) | self.forced
        j = np.minimum(j, len(self.at) - 1)
        return np.where(hit, self.out[j], x), np.where(hit, self.count[j], 0)

    def then(self, other: Map, span: int) -> Map:
        out, more = other.apply(self.out, span)
        at, count, forced = self.at, self.count + more, self.forced
        if not forced:
            new = other.at > at[-1] if len(at) else np.ones(len(other.at), bool)
            at, out = np.r_[at, other.at[new]], np.r_[out, other.out[new]]
            count, forced = np.r_[count, other.count[new]], other.forced
            if other.forced and not new.any():
                at, out, count = np.r_[at, at[-1:] + 1], np.r_[out, other.out[-1:]], np.r_[count, other.count[-1:]]
        return Map(at, out, count, forced)._short()

    def to_bytes(self) -> bytes:
        return bytes([self.forced]) + np.concatenate((self.at, self.out, self.count)).astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Map:
        at, out, count = np.frombuffer(data, "<i8", offset=1).reshape(3, -1)
        return cls(at, out, count, bool(data[0]))


def _segments(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of the run of equal keys of each row; null is a key."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _sessions(batch: pa.RecordBatch, ts: str, segment: np.ndarray, following: np.ndarray, seeds: np.ndarray) -> tuple:
    """(first row, row after the last, whether a start) of the sessions' parts in a batch, and the rows' starts."""
    n = batch.num_rows
    start = _reached(following, seeds)
    cut = start | np.r_[True, segment[1:] != segment[:-1]]
    first = np.flatnonzero(cut)
    return first, np.r_[first[1:], n], start[first], start


class _Follower:
    """The rows of one range in order; what a key that began here has open is carried from batch to batch."""

    def __init__(self, keys, ts, carry, span, gap, schema, known_first, part):
        self.keys, self.ts, self.carry, self.span, self.gap = keys, ts, carry, span, gap
        self.schema, self.part = schema, part
        self.key, self.open, self.last, self.count = None, FRESH, FRESH, 0
        self.head = not known_first  # whether rows may go on from the range before
        self.held: list[pa.RecordBatch] = []
        self.seq = 0

    def _row(self, kind: int, key: tuple, **values) -> pa.RecordBatch:
        row = dict(zip(self.keys, key, strict=True)) | {"_kind": kind, "_part": self.part, "_seq": self.seq} | values
        return pa.RecordBatch.from_pylist([row], schema=self.schema)

    def _block(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = pa.Table.from_batches(self.held).combine_chunks()
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows)
                image = sink.getvalue().to_pybytes()
            t = rows.column(self.ts)
            yield self._row(1, self.key, _n=rows.num_rows, _end=t[-1].as_py(), _image=image)
            self.held, self.seq = [], self.seq + 1

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        segment = _segments(batch, self.keys)
        key = tuple(batch.column(k)[0].as_py() for k in self.keys)
        goes_on = self.key is not None and key == self.key
        if self.head and (goes_on or self.key is None):
            self.key = key
            n = int(np.searchsorted(segment, 0, "right"))
            for i in range(0, n, BLOCK):
                self.held.append(batch.slice(i, min(BLOCK, n - i)).select([self.ts, *self.carry]))
                if sum(b.num_rows for b in self.held) >= BLOCK:
                    yield from self._block()
            if n == batch.num_rows:
                return
            batch, segment, goes_on = batch.slice(n), segment[n:] - segment[n], False
        if self.head:
            yield from self._block()
            self.head = False
        yield self._resolved(batch, segment, goes_on)

    def _resolved(self, batch: pa.RecordBatch, segment: np.ndarray, goes_on: bool) -> pa.RecordBatch:
        t = batch.column(self.ts).to_numpy()
        following = _next(t, segment, self.span, self.gap)
        heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        open_, before, count = (self.open, self.last, self.count) if goes_on else (FRESH, FRESH, 0)
        seeds = heads
        if goes_on:
            one = int(heads[1]) if len(heads) > 1 else len(t)
            first = first_break(t[:one], open_, before, self.span, self.gap)
            seeds = np.r_[[first] if first < one else [], heads[1:]].astype(np.int64)
        out, self.open, self.count = rows_of(batch, self.keys, self.ts, self.carry, segment, following, seeds, open_, count, self.schema)
        self.last, self.key = int(t[-1]), tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in self.keys)
        return out

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.head:
            yield from self._block()
        elif self.key is not None:
            yield self._row(2, self.key, _start=self.open, _end=self.last, _session=self.count)


def first_break(t: np.ndarray, open_: int, before: int, span: int, gap: int) -> int:
    """The first row that ends the session that is open before a run of rows."""
    if open_ == FRESH:
        return 0
    late = int(np.searchsorted(t, min(open_, FAR - span) + span, "left"))
    broken = np.flatnonzero(t - np.r_[before, t[:-1]] >= gap)
    return min(late, int(broken[0]) if len(broken) else len(t))


def rows_of(batch, keys, ts, carry, segment, following, seeds, open_, count, schema):
    """(rows, open start, sessions) of the sessions' parts in a batch; the first segment has ``count`` starts before it."""
    t = batch.column(ts).to_numpy()
    first, end, begins, start = _sessions(batch, ts, segment, following, seeds)
    total = np.cumsum(begins)
    own = segment[first]
    base = np.r_[0, total[np.flatnonzero(own[1:] != own[:-1])]]  # starts before each segment
    session = total - base[own - own[0]] + np.where(own == own[0], count, 0) - 1
    opened = np.where(begins, t[first], open_)
    table = {k: batch.column(k).take(pa.array(first)) for k in keys} | {c: batch.column(c).take(pa.array(first)) for c in carry}
    n = len(first)
    table |= {
        "_kind": pa.array(np.zeros(n, np.int32)),
        "_session": pa.array(session),
        "_start": pa.array(opened),
        "_end": pa.array(t[end - 1]),
        "_n": pa.array(end - first),
        "_begins": pa.array(begins),
    }
    columns = [table[f.name] if f.name in table else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema), int(opened[-1]), int(session[-1]) + 1


STEP = "_chain long, _idx long"


def _opened(written: DataFrame, keys: list[str], span: int, gap: int) -> DataFrame | None:
    """The blocks that may go on from before, with what is open before each: (_part, _seq, _open, _before, _count)."""
    w = Window.partitionBy(*keys).orderBy("_part", "_seq")
    marks = written.where("_kind > 0").select(*keys, "_kind", "_part", "_seq", "_start", "_end", "_session")
    chain = F.min(F.when(F.col("_kind") == 1, F.col("_part"))).over(Window.partitionBy(*keys)).cast("long")
    placed = marks.select(
        "*", chain.alias("_chain"), (F.row_number().over(w) - 1).cast("long").alias("_at"), F.lag("_end").over(w).alias("_before")
    ).where(F.col("_chain").isNotNull())
    # a key's first mark is the range where it begins, if that came before its blocks
    tail = F.max(F.when(F.col("_kind") == 2, 1).otherwise(0)).over(Window.partitionBy("_chain"))
    placed = placed.withColumn("_idx", F.col("_at") - tail)
    longest = placed.where("_kind = 1").agg(F.max("_idx")).first()[0]
    if longest is None:
        return None
    if longest:
        placed = scratch.written(placed, "chains")
    blocks = placed.where("_kind = 1").select("_chain", "_idx", "_part", "_seq", "_before")
    first = placed.where("_kind = 2").select("_chain", F.lit(0).cast("long").alias("_idx"), F.col("_start").alias("_open"), F.col("_session").alias("_count"))
    begun = blocks.where("_idx = 0").select("_chain", "_idx").join(first, ["_chain", "_idx"], "left")
    top = begun.select("_chain", "_idx", F.coalesce("_open", F.lit(FRESH)).alias("_open"), F.coalesce("_count", F.lit(0)).cast("long").alias("_count"))
    if not longest:  # no key goes over more than two ranges
        return blocks.join(top, ["_chain", "_idx"])
    held = written.where("_kind = 1").select("_part", "_seq", "_image")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for before, image in zip(batch.column("_before").to_pylist(), batch.column("_image"), strict=True):
                t = _rows(image).column(0).to_numpy()
                images.append(Map.of(t, FRESH if before is None else before, span, gap).to_bytes())
            yield pa.RecordBatch.from_arrays([batch.column("_chain"), batch.column("_idx"), pa.array(images, pa.binary())], ["_chain", "_idx", "_map"])

    # ``_image`` holds the times first
    level = blocks.join(held, ["_part", "_seq"]).select("_chain", "_idx", "_before", "_image").mapInArrow(mapped, f"{STEP}, _map binary")
    levels = [scratch.written(level, "maps")]

    def composed(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["_chain", "_idx", "_map"]).to_pylist(), key=lambda r: r["_idx"])
        whole = Map.from_bytes(rows[0]["_map"])
        for r in rows[1:]:
            whole = whole.then(Map.from_bytes(r["_map"]), span)
        return pa.table({"_chain": [rows[0]["_chain"]], "_idx": [rows[0]["_idx"] // FAN], "_map": pa.array([whole.to_bytes()], pa.binary())})

    size = longest
    while size >= FAN:
        above = levels[-1].groupBy("_chain", F.floor(F.col("_idx") / FAN).alias("_group")).applyInArrow(composed, f"{STEP}, _map binary")
        levels.append(scratch.written(above, "maps"))
        size //= FAN

    def walked(maps: pa.Table, entries: pa.Table) -> pa.Table:
        x, n = entries.column("_open")[0].as_py(), entries.column("_count")[0].as_py()
        out = []
        for r in sorted(maps.select(["_chain", "_idx", "_map"]).to_pylist(), key=lambda r: r["_idx"]):
            out.append((r["_chain"], r["_idx"], x, n))
            after, more = Map.from_bytes(r["_map"]).apply(np.array([x]), span)
            x, n = int(after[0]), n + int(more[0])
        return pa.table(list(map(list, zip(*out, strict=True))), names=["_chain", "_idx", "_open", "_count"])

    entries = top
    for level in reversed(levels):
        below = level.withColumn("_group", F.floor(F.col("_idx") / FAN)).groupBy("_chain", "_group")
        given = entries.withColumn("_group", F.col("_idx")).groupBy("_chain", "_group")
        entries = below.cogroup(given).applyInArrow(walked, f"{STEP}, _open long, _count long")
    return blocks.join(entries, ["_chain", "_idx"])


def _rows(image: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(image.as_buffer()).read_all().combine_chunks()


def sessions(df: DataFrame, keys: list[str], ts: str, span: int, gap: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Parts of sessions: (keys, _session, _start, _end, _n, _begins, carry) where a session ends once it would last ``span``
    or after ``gap`` without a row; rows of a key in the order of ``ts`` and ``carry`` (those of the part's first row).

    A session that goes over several blocks has several parts, of which the first ``_begins`` it.  Null keys are a key of
    their own; rows with a null ``ts`` are in no session; times and spans are whole numbers.  An empty table gives no rows.

    One shuffle by keys or, if a key has more than ``ALONE`` rows, into ranges of (keys, ts, carry); a task holds a batch, or
    one block of ``BLOCK`` rows.
    """
    gap = FAR if gap is None else gap
    picked = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("long").alias(ts), *carry)
    typed = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    more = "_kind int, _part int, _seq int, _session long, _start long, _end long, _n long, _begins boolean, _image binary"
    ddl = ", ".join([*(f"`{c}` {typed[c]}" for c in (*keys, *carry)), more])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def follower(known_first: bool):
        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            own = _Follower(keys, ts, list(carry), span, gap, schema, known_first or part == 0, part)
            for batch in batches:
                if batch.num_rows:
                    yield from own.take(batch)
            yield from own.close()

        return follow

    out = [*keys, "_session", "_start", "_end", "_n", "_begins", *carry]
    order = [F.col(c).asc_nulls_first() for c in (*keys, ts, *carry)]
    if picked.groupBy(*keys).count().where(F.col("count") > ALONE).isEmpty():
        whole = picked.repartition(*keys).sortWithinPartitions(*order)
        return whole.mapInArrow(follower(True), ddl).where("_kind = 0").select(*out)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = picked.repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = scratch.written(ranged.mapInArrow(follower(False), ddl), "sessions")
    done = written.where("_kind = 0")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _rows(batch.column("_image")[i])
                t = rows.column(ts).to_numpy()
                x, before, count = (batch.column(c)[i].as_py() for c in ("_open", "_before", "_count"))
                first = first_break(t, x, FRESH if before is None else before, span, gap)
                whole = rows.to_batches()[0]
                for k in keys:
                    whole = whole.append_column(k, pa.array([batch.column(k)[i].as_py()] * len(t), schema.field(k).type))
                zero = np.zeros(len(t), np.int64)
                seeds = np.array([first] if first < len(t) else [], np.int64)
                yield rows_of(whole, keys, ts, list(carry), zero, _next(t, zero, span, gap), seeds, x, count, schema)[0]

    before = _opened(written, keys, span, gap)
    if before is None:
        return done.select(*out)
    blocks = written.where("_kind = 1").select(*keys, "_part", "_seq", "_image")
    rest = blocks.join(before, ["_part", "_seq"]).select(*keys, "_open", "_before", "_count", "_image")
    return done.select(*out).unionByName(rest.mapInArrow(opened, ddl).select(*out))
