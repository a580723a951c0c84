"""Stateful processors: the batch kernels with their state in the state store and timers of the stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skerry.config import ReorderConfig, StitchConfig, check_timeouts
from skerry.functions.kernels import Reorder, Stitch, TtlFirst
from skerry.operators.streams import TRANSMISSION


class TtlDedup(StatefulProcessor):
    """First row of an id, again after ``ttl_ms`` of the rows' own time ``ts_ms``.

    If ``expiring``, an id's state lives until its time to live is over, both by its own time and since it was set: a timer on
    processing time deletes it then, so the store holds the ids of one time to live, not all that were ever seen.  Where rows come
    more slowly than their own time says, an id may so be let through again after ``ttl_ms`` of the clock.
    """

    def __init__(self, ttl_ms: int, expiring: bool):
        self.ttl, self.expiring = ttl_ms, expiring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.until.get()[0] if self.until.exists() else None
        kernel = TtlFirst(self.ttl, before)
        batch = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        passed = [kernel.on_row(int(t)) for t in batch.ts_ms]
        if kernel.until != before:
            self.until.update((kernel.until,))
            if self.expiring:
                for due in self.handle.listTimers():
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(max(kernel.until, timerValues.getCurrentProcessingTimeInMs() + self.ttl))
        yield batch[passed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


class Transmissions(StatefulProcessor):
    """Reorder and stitch the chunks of one feed in one processor; late chunks are never dropped, as the stream
    has no watermark.  Rows carry ``seq`` for their order of arrival; timers run on processing time.
    """

    def __init__(self, reorder: ReorderConfig, stitch: StitchConfig):
        check_timeouts(reorder, stitch)
        self.reorder_config, self.stitch_config = reorder, stitch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state binary")

    def _load(self) -> tuple[Reorder, Stitch, dict]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else (None, None, {}, (None, None))
        self.stale = held[3]
        return Reorder(self.reorder_config, held[0]), Stitch(self.stitch_config, held[1]), held[2]

    def _save(self, reorder: Reorder, stitch: Stitch, meta: dict, now: int) -> None:
        # the deadline moves with new speech alone: ``stale_ms`` after it came, whatever else happens until then
        if stitch.s["stale_at"] != self.stale[0]:
            due = None if stitch.s["stale_at"] is None else now + self.stitch_config.stale_ms
            self.stale = (stitch.s["stale_at"], due)
        self.state.update((pickle.dumps((reorder.s, stitch.s, meta, self.stale)),))
        for due in self.handle.listTimers():
            self.handle.deleteTimer(due)
        if reorder.s["due"] is not None:
            self.handle.registerTimer(max(reorder.s["due"], now + 1))
        if self.stale[1] is not None:
            self.handle.registerTimer(max(self.stale[1], now + 1))

    def _stitched(self, key, ready: list[dict], stitch: Stitch, meta: dict) -> list[dict]:
        out = []
        for r in ready:
            held = meta[r["gcs_uri"]]  # of a chunk and its repeat, what came first goes first
            length, segments = held.pop(0)
            if not held:
                del meta[r["gcs_uri"]]
            if r["kind"] != "discarded":
                out += stitch.on_chunk(r["gcs_uri"], r["event_ts_ms"], length, segments)
        return [{"feed_id": key[0]} | r for r in out]

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSMISSION.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reorder, stitch, meta = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        out: list[dict] = []
        for r in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            segments = [(int(s["start_ms"]), int(s["end_ms"])) for s in r["speech_segments"]]
            meta.setdefault(r["gcs_uri"], []).append((int(r["duration_ms"]), segments))
            ready = reorder.on_chunk(int(r["event_ts_ms"]), r["gcs_uri"], r["session_id"], now)
            out += self._stitched(key, ready, stitch, meta)
        self._save(reorder, stitch, meta, now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reorder, stitch, meta = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        stale = self.stale
        out = self._stitched(key, reorder.on_time(now), stitch, meta)
        if stale[1] is not None and now >= stale[1] and stitch.s["stale_at"] == stale[0]:
            out += [{"feed_id": key[0]} | r for r in stitch.on_time(None)]
        self._save(reorder, stitch, meta, now)
        yield self._frame(out)

    def close(self) -> None:
        pass


def dedup_stream(alerts: DataFrame, key: str, ttl_ms: int = 3_600_000, expiring: bool = False) -> DataFrame:
    """A stream of alerts (with ``ts_ms``), the first of each id within its time to live.

    A query without end should be ``expiring``: timers then delete what is over.  Timers keep Spark making batches, so a run
    over what is there (``availableNow``) would not end with them; it keeps every id that it sees.
    """
    return alerts.groupBy(key).transformWithStateInPandas(
        statefulProcessor=TtlDedup(ttl_ms, expiring), outputStructType=alerts.schema, outputMode="Append",
        timeMode="ProcessingTime" if expiring else "None",
    )


def transmissions_stream(
    chunks: DataFrame, reorder: ReorderConfig | None = None, stitch: StitchConfig | None = None
) -> DataFrame:
    """A stream of chunks (feed_id, session_id, gcs_uri, event_ts_ms, duration_ms, speech_segments, seq) as
    transmissions.
    """
    return chunks.groupBy("feed_id").transformWithStateInPandas(
        statefulProcessor=Transmissions(reorder or ReorderConfig(), stitch or StitchConfig()),
        outputStructType=TRANSMISSION,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def exactly_once(messages: DataFrame, uri: str = "chunk_uri", ts: str = "event_ts", delay: str = "10 minutes") -> DataFrame:
    """A source's repeats away, by an attribute, within the watermark."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([uri])
