"""Keyed, ordered operators over batch tables; the same kernels run in ``skerry.streaming``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skerry.config import ReorderConfig, StitchConfig
from skerry.functions.kernels import Reorder, Stitch
from skerry.operators import orbits
from skerry.sources import scratch


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(df: DataFrame, keys: list[str], order: list[str], make: Callable, schema: str) -> DataFrame:
    """Feed the rows of each key in order to a fresh kernel: ``make()`` gives ``(on_row, at_end)``, functions
    from a row to output rows.

    One shuffle on the keys and a sort that spills; a task holds one batch and one kernel's state, never a
    whole key.  Null keys are a key of their own; whole numbers stay whole.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, on_row, at_end = None, None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if on_row is None or own != key:
                    if at_end:
                        out += [dict(zip(keys, key, strict=True)) | r for r in at_end()]
                    key, (on_row, at_end) = own, make()
                out += [dict(zip(keys, key, strict=True)) | r for r in on_row(row)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if at_end:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | r for r in at_end()], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def gap_sessions(df: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """``df`` with a session number per key: a new one where ``ts`` is ``gap`` or more after the row before."""
    w = Window.partitionBy(key).orderBy(ts, *[c for c in df.columns if c not in (key, ts)])
    new, name = F.when(F.col(ts) - F.lag(ts).over(w) < gap, 0).otherwise(1), unused(df, "_new")
    return df.withColumn(name, new).withColumn("session", F.sum(name).over(w) - 1).drop(name)


def gap_max_sessions(df: DataFrame, key: str, ts: str, gap: int, longest: int) -> DataFrame:
    """(key, session, start_ms, end_ms, n_rows) where a session also ends once it would last ``longest``.  Rows without a
    time are in no session.
    """
    parts = orbits.sessions(df, [key], ts, longest, gap)
    return parts.groupBy(key, F.col("_session").alias("session")).agg(
        F.min("_start").alias("start_ms"), F.max("_end").alias("end_ms"), F.sum("_n").alias("n_rows")
    )


def ttl_first(df: DataFrame, keys: list[str], ts: str, ttl: int, *carry: str) -> DataFrame:
    """The rows that pass a set-if-absent with a time to live, in the order of ``ts`` and ``carry``.  Rows without a time
    don't pass.
    """
    parts = orbits.sessions(df, keys, ts, ttl, carry=carry)
    return parts.where("_begins").select(*keys, F.col("_start").alias(ts), *carry)


def reorder(chunks: DataFrame, config: ReorderConfig | None = None) -> DataFrame:
    """Replay of arrivals (feed_id, session_id, gcs_uri, event_ts_ms, arrival_ts_ms, seq) through the jitter
    buffer; ``place`` is the order of emission.  What still waits at the end goes out at its timer.
    """

    def make():
        kernel, n = Reorder(config), iter(range(1 << 62))

        def number(rows):
            return [r | {"place": next(n)} for r in rows]

        def on_row(r):
            now = r["arrival_ts_ms"]
            return number(
                kernel.on_time(now) + kernel.on_chunk(r["event_ts_ms"], r["gcs_uri"], r["session_id"], now)
            )

        return on_row, lambda: number(kernel.on_time(1 << 62))

    columns = ["feed_id", "session_id", "gcs_uri", "event_ts_ms", "arrival_ts_ms", "seq"]
    return fold(
        chunks.select(*columns),
        ["feed_id"],
        ["seq"],
        make,
        "feed_id long, event_ts_ms long, gcs_uri string, kind string, place long",
    )


TRANSMISSION = (
    "feed_id long, contributing_audio_uris array<string>, start_ms long, end_ms long, missing_prior_context boolean, "
    "missing_post_context boolean, start_audio_offset_ms long, reason string, audio_ms long"
)


def stitch(chunks: DataFrame, config: StitchConfig | None = None, order: Column | None = None) -> DataFrame:
    """Transmissions from (feed_id, gcs_uri, start_ms, duration_ms, speech_segments) in the order of ``place``."""

    def make():
        kernel = Stitch(config)

        def on_row(r):
            own = r["speech_segments"] if r["speech_segments"] is not None else []
            segments = [(int(s["start_ms"]), int(s["end_ms"])) for s in own]
            yield from kernel.on_chunk(r["gcs_uri"], r["start_ms"], r["duration_ms"], segments)

        return on_row, lambda: list(kernel.on_time(None))

    columns = ["feed_id", "gcs_uri", "start_ms", "duration_ms", "speech_segments", "place"]
    return fold(chunks.select(*columns), ["feed_id"], ["place"], make, TRANSMISSION)


def run_intervals(df: DataFrame, key: str, ts: str, flag: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """(key, start, end, n): runs of rows with a true flag, in the order of ``ts`` and ``ties``; a null flag is
    false.
    """
    w, on = Window.partitionBy(key).orderBy(ts, *ties), F.coalesce(F.col(flag), F.lit(False))
    change, run = unused(df, "_change"), unused(df, "_run")
    begins = F.when(on == F.coalesce(F.lag(on).over(w), F.lit(False)), 0).otherwise(1)
    return (
        df.withColumn(change, begins)
        .withColumn(run, F.sum(change).over(w))
        .where(on)
        .groupBy(key, run)
        .agg(F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count(F.lit(1)).alias("n_rows"))
        .drop(run)
    )


def majority(df: DataFrame, key: str, order: list[str], flag: str, half: int) -> DataFrame:
    """``on``: whether most of the ``2 * half + 1`` rows around are true (rows beyond the ends are false)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("on", F.sum(F.col(flag).cast("int")).over(w) * 2 > 2 * half + 1)


def hangover(df: DataFrame, key: str, order: list[str], flag: str, rows: int) -> DataFrame:
    """``held``: whether this row or one of the ``rows`` before it is true."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-rows, 0)
    return df.withColumn("held", F.max(flag).over(w))


_ROW_BITS = 33  # of the ids that Spark numbers the rows of a partition by


def _ranged(df: DataFrame, order: list[Column], own: str) -> tuple[DataFrame, Column, Column]:
    """``df`` in ranges of ``order``, each one sorted and a partition, written once; the number of a row's range, and its
    place there.  Equal rows are told apart by a number of their own, so they can fill several ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(own).asc()]
    numbers = F.monotonically_increasing_id()
    dealt = df.withColumn(own, numbers).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(own, numbers)
    return scratch.written(dealt, "ranges"), F.shiftright(own, _ROW_BITS), F.col(own).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def _before(ranged: DataFrame, part: Column, amount: Column) -> DataFrame:
    """(_p, _start): what the ranges before a range sum up to; one row a range."""
    sums = ranged.groupBy(part.alias("_p")).agg(F.sum(amount).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select("_p", (F.sum("_n").over(w) - F.col("_n")).alias("_start"))


def _order(df: DataFrame, order: list[str | Column]) -> list[Column]:
    """The order given, then the other columns (first their hash), null first throughout."""
    given = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    named = [c for c in order if isinstance(c, str)]
    rest = [c for c in df.columns if c not in named]
    return [*given, *([F.xxhash64(*rest)] if rest else []), *[F.col(c).asc_nulls_first() for c in rest]]


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with ``number`` from 0 in the order given (columns: null first; ties by the other columns' hash, then by
    those columns, so only equal rows are left to chance), without one task for all rows.

    One shuffle into ranges of any sortable key, written once to the shared folder; what stands before a range is the sum
    of one count for each range, and a row's place in its range is known from its partition.  A column ``number`` is
    replaced; an empty table stays empty.
    """
    df = df.drop(name)
    own = unused(df, "_own")
    ranged, part, place = _ranged(df, _order(df, list(order)), own)
    starts = F.broadcast(_before(ranged, part, F.lit(1)))  # one row a range
    return ranged.join(starts, part == F.col("_p")).select(*df.columns, (F.col("_start") + place).cast("long").alias(name))


def running_total(df: DataFrame, amount: str, *order: str | Column, name: str = "before") -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` (null: 0) over the rows before in the order given, as in
    ``numbered``; sums inside a range are windows over that range.
    """
    df = df.drop(name)
    own, at, given = unused(df, "_own"), unused(df, "_at"), F.coalesce(F.col(amount), F.lit(0)).cast("long")
    ranged, part, _ = _ranged(df, _order(df, list(order)), own)
    starts = F.broadcast(_before(ranged, part, given))  # one row a range
    inside = F.sum(given).over(Window.partitionBy(at).orderBy(own).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn(at, part).withColumn(name, inside - given)
    return placed.join(starts, F.col(at) == F.col("_p")).select(*df.columns, (F.col("_start") + F.col(name)).alias(name))


def merged_by_place(left: DataFrame, right: DataFrame, key: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of two tables side by side, the n-th with the n-th in the order of ``key``.

    ``key`` and the columns ``same`` must agree on both sides and the tables must be equally long, else the job
    fails; the other columns of ``right`` are added.
    """
    theirs = [c for c in right.columns if c != key and c not in same]
    a = numbered(left, key).select("number", F.struct(*left.columns).alias("_a"))
    b = numbered(right, key).select("number", F.struct(*right.columns).alias("_b"))
    fits = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in (key, *same):
        fits = fits & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    wrong = F.raise_error(F.lit("rows of the merged tables differ"))
    checked = a.join(b, "number", "full").select(F.when(fits, F.col("_a")).otherwise(wrong).alias("_a"), "_b")
    return checked.select("_a.*", *[F.col(f"_b.{c}").alias(c) for c in theirs])


#: Rows of a key's table that one task sorts, about.
TASK_ROWS = 1 << 20


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the rows of a stored table need, so that what one sorts doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def within_key(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its key, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def chunk_starts(df: DataFrame, key: str, ts: str, order: list[str], chunk_ms: int) -> DataFrame:
    """``df`` with ``n``, the row's place in its key, and ``chunk_start_ms``: chunks laid end to end from the
    key's first time on.
    """
    first = F.min(ts).over(Window.partitionBy(key))
    return within_key(df, key, order, "n").withColumn("chunk_start_ms", (first + F.col("n") * chunk_ms).cast("long"))


def first_of(df: DataFrame, ids: list[str], ts: str) -> DataFrame:
    """What ``streaming.processors.exactly_once`` lets through of a whole table without late rows: the first row
    of each id.
    """
    return df.groupBy(*ids).agg(F.min(ts).alias(ts))
