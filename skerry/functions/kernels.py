"""Order-dependent folds, one key at a time: batch operators and stateful processors share them.

Each takes one row after the other in its order and gives back output rows; its state is a small dict that a
state store can keep.
"""

from __future__ import annotations

from collections.abc import Iterator

from skerry.config import ReorderConfig, StitchConfig

Row = dict


class Reorder:
    """A jitter buffer: chunks within the tolerance of the expected time go out, early ones wait, late ones go
    out at once without moving what is expected.
    """

    def __init__(self, config: ReorderConfig | None = None, state: dict | None = None):
        self.c = config or ReorderConfig()
        self.s = state or {"session": None, "expected": None, "waiting": [], "due": None}

    def _drain(self) -> list[tuple[int, str]]:
        out, kept = [], []
        for ts, uri in sorted(self.s["waiting"]):
            if abs(ts - self.s["expected"]) <= self.c.tolerance_ms:
                out.append((ts, uri))
                self.s["expected"] = ts + self.c.chunk_ms
            else:
                kept.append((ts, uri))
        self.s["waiting"] = kept
        return out

    def on_time(self, now_ms: int) -> list[Row]:
        """The gap timer: when due, what waits longest becomes what is expected."""
        s = self.s
        if s["due"] is None or now_ms < s["due"]:
            return []
        s["due"] = None
        if not s["waiting"]:
            return []
        s["expected"] = min(s["waiting"])[0]
        return [{"event_ts_ms": t, "gcs_uri": u, "kind": "gap"} for t, u in self._drain()]

    def on_chunk(self, ts: int, uri: str, session: str, now_ms: int) -> list[Row]:
        s, out = self.s, []
        if s["session"] != session:
            out = [{"event_ts_ms": t, "gcs_uri": u, "kind": "discarded"} for t, u in sorted(s["waiting"])]
            s.update(session=session, expected=None, waiting=[], due=None)
        if s["expected"] is None:
            s["expected"] = ts
        ahead = ts - s["expected"]
        if ahead > self.c.tolerance_ms:
            s["waiting"].append((ts, uri))
        else:
            late = ahead < -self.c.tolerance_ms
            out.append({"event_ts_ms": ts, "gcs_uri": uri, "kind": "late" if late else "ordered"})
            if not late:
                s["expected"] = ts + self.c.chunk_ms
                out += [{"event_ts_ms": t, "gcs_uri": u, "kind": "drained"} for t, u in self._drain()]
        if s["waiting"] and s["due"] is None:
            s["due"] = now_ms + self.c.timeout_ms
        elif not s["waiting"]:
            s["due"] = None
        return out


def _fresh() -> dict:
    return {
        "tx_start": None, "buf_start": None, "buf_dur": 0, "last_end": None, "uris": [], "prior": False,
        "expected": None, "start_off": None, "stale_at": None,
    }


class Stitch:
    """Transmissions from chunks with speech segments: closed by gaps, by the longest duration, by missing
    chunks and by staleness; late chunks make transmissions of their own.
    """

    def __init__(self, config: StitchConfig | None = None, state: dict | None = None):
        self.c = config or StitchConfig()
        self.s = state or _fresh()

    def _flush(self, s: dict, reason: str, post: bool, audio: list[int]) -> Iterator[Row]:
        if audio[0] <= 0:
            return
        start = s["buf_start"] if s["buf_start"] is not None else s["tx_start"]
        yield {
            "contributing_audio_uris": list(s["uris"]),
            "start_ms": start,
            "end_ms": start + s["buf_dur"] if s["buf_dur"] else (s["last_end"] or start),
            "missing_prior_context": bool(s["prior"]),
            "missing_post_context": bool(post),
            "start_audio_offset_ms": s["start_off"],
            "reason": reason,
            "audio_ms": audio[0],
        }

    def _reset(self, s: dict) -> None:
        s.update(tx_start=None, buf_start=None, buf_dur=0, uris=[], start_off=None)

    def _take(self, s: dict, audio: list[int], a: int, b: int) -> None:
        if b > a:
            s["buf_dur"] += b - a
            audio[0] += b - a

    def _silent(self, s: dict, audio: list[int], uri: str, f: int, length: int, late: bool) -> Iterator[Row]:
        c, end = self.c, s["last_end"]
        gap = end is not None and f - end >= c.gap_ms
        long = s["tx_start"] is not None and f + length - s["tx_start"] >= c.max_ms
        if s["tx_start"] is None:
            s["stale_at"] = None
        if gap or long:
            if s["tx_start"] is not None:
                self._take(s, audio, 0, max(0, min(length, end + c.post_roll_ms - f)))
                reason = "gap in silence" if gap else "longest duration in silence"
                yield from self._flush(s, reason, long, audio)
                audio[0] = 0 if not late else audio[0]
                s["prior"] = False
            self._reset(s)
            s["stale_at"] = None
        elif s["tx_start"] is not None:
            if uri not in s["uris"]:
                s["uris"].append(uri)
            s["stale_at"] = (end or f + length) + c.stale_ms
            self._take(s, audio, 0, min(length, max(0, end + c.post_roll_ms - f)))

    def _speech(self, s: dict, audio: list[int], uri: str, f: int, length: int, segments, late: bool) -> Iterator[Row]:
        c, cursor = self.c, None
        for b, e in segments:
            start = f + b
            gap = s["last_end"] is not None and start - s["last_end"] >= c.gap_ms
            long = s["tx_start"] is not None and start - s["tx_start"] >= c.max_ms
            if gap or long:
                if s["tx_start"] is not None:
                    x, y = cursor or 0, min(s["last_end"] + c.post_roll_ms - f, b)
                    if 0 <= x < y:
                        self._take(s, audio, x, y)
                    yield from self._flush(s, "gap" if gap else "longest duration", long, audio)
                    audio[0] = 0 if not late else audio[0]
                    s["prior"] = long
                self._reset(s)
                cursor = None
            if s["tx_start"] is None:
                if s["prior"] and b > 0:
                    s["prior"] = False
                a = max(0, b - c.pre_roll_ms)
                s.update(tx_start=start, start_off=a, buf_start=f + a)
            else:
                a = cursor or 0
            end = min(length, e + c.post_roll_ms)
            if end > a:
                self._take(s, audio, a, end)
                cursor = end
            if uri not in s["uris"]:
                s["uris"].append(uri)
            s["last_end"] = f + e
        s["stale_at"] = s["last_end"] + c.stale_ms

    def on_chunk(self, uri: str, f: int, length: int, segments: list[tuple[int, int]]) -> Iterator[Row]:
        s, c = self.s, self.c
        audio = s.setdefault("audio", [0])
        if s["expected"] is not None and f < s["expected"] - c.tolerance_ms:
            own, sound = _fresh() | {"prior": True}, [0]
            if segments:
                yield from self._speech(own, sound, uri, f, length, segments, True)
                yield from self._flush(own, "late chunk", segments[-1][1] >= c.chunk_ms, sound)
            return
        if s["expected"] is not None and f > s["expected"] + c.tolerance_ms:
            if s["tx_start"] is not None:
                yield from self._flush(s, "missing chunk", True, audio)
                audio[0] = 0
                self._reset(s)
            s["prior"] = True
        s["expected"] = f + c.chunk_ms
        yield from (
            self._speech(s, audio, uri, f, length, segments, False)
            if segments
            else self._silent(s, audio, uri, f, length, False)
        )

    def on_time(self, event_ms: int | None) -> Iterator[Row]:
        """The stale timer at an event time; None is the end of the input."""
        s = self.s
        if s["stale_at"] is None or (event_ms is not None and event_ms < s["stale_at"]):
            return
        if s["tx_start"] is not None and s.get("audio", [0])[0] > 0:
            for row in self._flush(s, "stale", True, s["audio"]):
                yield row | {"start_ms": s["tx_start"], "end_ms": s["last_end"]}
        self.s.clear()
        self.s.update(_fresh() | {"audio": [0]})


class TtlFirst:
    """True for the first of an id, and again once its time is over; repeats don't prolong it."""

    def __init__(self, ttl: int, until: int | None = None):
        self.ttl, self.until = ttl, until

    def on_row(self, now: int) -> bool:
        if self.until is not None and now < self.until:
            return False
        self.until = now + self.ttl
        return True


class GapMax:
    """Session numbers: a new one after a gap or once the session would get too long."""

    def __init__(self, gap: int, longest: int):
        self.gap, self.longest, self.last, self.start, self.n = gap, longest, None, None, -1

    def on_row(self, ts: int) -> tuple[int, int]:
        if self.last is None or ts - self.last >= self.gap or ts - self.start >= self.longest:
            self.start, self.n = ts, self.n + 1
        self.last = ts
        return self.n, self.start


def align(reference: list[str], said: list[str]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a least-cost word alignment.

    Of equal costs a pair of words goes before a deletion, and that before an insertion.  The counts of a cell are
    one number in digits of base ``len(reference) + len(said) + 1``.
    """
    digit = len(reference) + len(said) + 1
    hit, substitution, deletion, insertion = digit**3, digit**2, digit, 1
    costs, counts = list(range(len(said) + 1)), list(range(len(said) + 1))
    for r in reference:
        above, above_n = costs[0], counts[0]
        cost, n = above + 1, above_n + deletion
        costs[0], counts[0] = cost, n
        for j, w in enumerate(said, 1):
            left, left_n = cost, n
            cost, n = (above, above_n + hit) if r == w else (above + 1, above_n + substitution)
            above, above_n = costs[j], counts[j]
            if above + 1 < cost:
                cost, n = above + 1, above_n + deletion
            if left + 1 < cost:
                cost, n = left + 1, left_n + insertion
            costs[j], counts[j] = cost, n
    n, insertions = divmod(counts[-1], digit)
    n, deletions = divmod(n, digit)
    return (*divmod(n, digit), deletions, insertions)
