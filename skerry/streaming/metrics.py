"""Counters and distributions that queries report while they run."""

from __future__ import annotations

import operator
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from skerry.functions import columns as C
from skerry.operators import quantiles


def counters(kind: str, *values: str) -> list[Column]:
    """One count per value of a column, named after the value."""
    return [F.count_if(F.col(kind) == v).alias(v.replace(" ", "_")) for v in values]


#: Quantiles that a distribution reports, from a sketch of each batch.
REPORTED = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def distribution(name: str, value: Column | None = None) -> list[Column]:
    """Count, sum, least and greatest value of a column (or ``value``), and quantiles of the batch within the sketch's
    error.
    """
    c = F.col(name) if value is None else value
    sketch = F.kll_sketch_agg_double(c.cast("double"), F.lit(quantiles.SKETCH_K))
    return [
        F.count(c).alias(f"{name}_n"),
        F.sum(c).alias(f"{name}_sum"),
        F.min(c).alias(f"{name}_min"),
        F.max(c).alias(f"{name}_max"),
        *[F.when(F.count(c) > 0, quantiles.quantile(sketch, q)).alias(f"{name}_{p}") for p, q in REPORTED.items()],
    ]


def reorder_metrics(ordered: DataFrame, to="reorder") -> DataFrame:
    """The rows of ``streams.reorder``, observed as ``to`` (a name or an ``Observation``) in passing."""
    return ordered.observe(to, *counters("kind", "ordered", "drained", "gap", "late", "discarded"))


def stitch_metrics(found: DataFrame, to="stitch") -> DataFrame:
    """The rows of ``streams.stitch``: flushes by reason, and how long they are."""
    reasons = ("stale", "gap", "gap in silence", "longest duration", "longest duration in silence", "missing chunk", "late chunk")
    return found.observe(
        to,
        *counters("reason", *reasons),
        F.count_if(F.size("contributing_audio_uris") > 1).alias("from_several_chunks"),
        *distribution("audio_ms"),
    )


def dead_letter_metrics(letters: DataFrame, stages: tuple[str, ...], to="dead_letters") -> DataFrame:
    """The rows of ``tables.dead_letters``: how many there are, and how many of each stage."""
    return letters.observe(to, F.count(F.lit(1)).alias("dead_letters"), *counters("stage", *stages))


def detector_metrics(checked: DataFrame, voice: str = "voice", speech_ms: str = "detector_ms", took_ms: str | None = None, to="detector") -> DataFrame:
    """The rows of ``signal.voice_check``: speech and silence, how long the speech is, and how long the checks took where
    a column says so.
    """
    took = distribution("detector_time_ms", F.col(took_ms)) if took_ms else []
    said = F.coalesce(F.col(voice), F.lit(False))
    length = distribution("speech_ms", F.when(said, F.col(speech_ms)))
    return checked.observe(to, F.count_if(said).alias("speech"), F.count_if(~said).alias("silence"), *length, *took)


def transcription_metrics(done: DataFrame, text: str = "text", took_ms: str = "took_ms", error: str = "error", to="transcription") -> DataFrame:
    """Transcribed rows: how many have a text, are blank or failed, and how long they took."""
    failed = F.col(error).isNotNull()
    said = F.coalesce(C.not_blank(F.col(text)), F.lit(False))
    return done.observe(
        to,
        F.count_if(~failed & said).alias("transcribed"),
        F.count_if(~failed & ~said).alias("blank"),
        F.count_if(failed).alias("failed"),
        *distribution("transcription_time_ms", F.col(took_ms)),
    )


class Totals(StreamingQueryListener):
    """Sums of the observed counts of all streaming batches, and least and greatest values, by name.

    Handed to ``spark.streams.addListener``.  Other exporters are listeners of their own beside it.
    """

    def __init__(self) -> None:
        self.values: dict[str, dict[str, int]] = defaultdict(dict)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            held = self.values[name]
            for field, value in row.asDict().items():
                if value is not None:
                    if field.rsplit("_", 1)[-1] in REPORTED:  # those of the newest batch
                        held[field] = value
                        continue
                    join = min if field.endswith("_min") else max if field.endswith("_max") else operator.add
                    held[field] = join(held[field], value) if field in held else value

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
