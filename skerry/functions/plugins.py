"""Detectors of speech and transcribers by name, applied to chunks where they are read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.config import GateConfig
from skerry.functions import signal

#: name -> factory: takes a dict of settings, gives a function of one chunk's samples.
DETECTORS: dict[str, Callable[[dict], Callable[[np.ndarray], list[tuple[int, int]]]]] = {}
TRANSCRIBERS: dict[str, Callable[[dict], Callable[[np.ndarray], str | None]]] = {}


def register(kind: dict, name: str):
    """Adds a factory; the module that does so must be importable by executors."""

    def keep(factory):
        kind[name] = factory
        return factory

    return keep


def build(kind: dict, name: str, settings: str | None):
    """The function of that name, from settings as a JSON object; empty settings are the defaults."""
    if name not in kind:
        raise ValueError(f"unknown plugin {name!r}: one of {sorted(kind)}")
    try:
        given = json.loads(settings) if settings else {}
        if not isinstance(given, dict):
            raise ValueError("not an object")
        return kind[name](given)
    except (ValueError, TypeError) as error:
        raise ValueError(f"invalid settings for {name}: {error}") from error


@register(DETECTORS, "gate")
def _gate(settings: dict):
    c = replace(GateConfig(), **settings)
    return lambda samples: signal.gate(samples, c)


def _samples(pcm: bytes | None) -> np.ndarray:
    return np.frombuffer(pcm or b"", "<i2")


def apply_plugin(chunks: DataFrame, kind: dict, name: str, settings: str | None, pcm: str, out: str, sql_type: str) -> DataFrame:
    """``chunks`` with the plugin's answer for the 16-bit samples in ``pcm`` as ``out``, and ``error``.

    Settings are checked before the job starts.  A chunk that a plugin fails on has a null answer and the error's
    text, so it can go to the dead letters.  The plugin is built once a task.
    """
    build(kind, name, settings)
    factory = kind[name]
    given = json.loads(settings) if settings else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory(given)
        for batch in batches:
            answers, errors = [], []
            for value in batch[pcm]:
                try:
                    answers.append(call(_samples(value)))
                    errors.append(None)
                except Exception as error:  # becomes a dead letter
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch.drop(columns=[pcm]).assign(**{out: answers, "error": errors})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != pcm]
    return chunks.mapInPandas(run, ", ".join([*kept, f"`{out}` {sql_type}", "error string"]))


def detect(chunks: DataFrame, name: str = "gate", settings: str | None = None, pcm: str = "pcm") -> DataFrame:
    """``chunks`` with ``speech_segments`` (file-relative ms) in the place of their samples."""
    found = apply_plugin(chunks, DETECTORS, name, settings, pcm, "_found", "array<array<long>>")
    segment = F.transform("_found", lambda s: F.struct(s[0].alias("start_ms"), s[1].alias("end_ms")))
    return found.withColumn("speech_segments", segment).drop("_found")


def transcribe(chunks: DataFrame, name: str, settings: str | None = None, pcm: str = "pcm") -> DataFrame:
    """``chunks`` with ``transcript`` in the place of their samples; blank ones are null."""
    found = apply_plugin(chunks, TRANSCRIBERS, name, settings, pcm, "transcript", "string")
    return found.withColumn("transcript", F.nullif(F.trim("transcript"), F.lit("")))
