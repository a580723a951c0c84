"""Framed signal measures in numpy, and the acoustic gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.config import GateConfig


def rms(samples: np.ndarray, hop: int = 512, frame: int = 2048) -> np.ndarray:
    """Root mean square per frame, frames centred by reflection at the ends."""
    x = np.asarray(samples, np.float64)
    if not len(x):
        return np.zeros(0)
    x = np.pad(x, frame // 2, mode="reflect" if len(x) > 1 else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    return np.sqrt(np.mean(frames**2, axis=1))


def flatness(samples, rate, fft=2048, hop=512, power=2.0, least=1e-10, band=None) -> np.ndarray:
    """Geometric over arithmetic mean of the band's spectrum, per frame."""
    x = np.asarray(samples, np.float64)
    if not len(x):
        return np.zeros(0)
    x = np.pad(x, (fft // 2, fft // 2))
    x = np.pad(x, (0, -(len(x) - fft) % hop))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    frames = np.lib.stride_tricks.sliding_window_view(x, fft)[::hop]
    spectrum = np.maximum(np.abs(np.fft.rfft(frames * window, axis=1) / window.sum()) ** power, least)
    if band is not None:
        bins = np.fft.rfftfreq(fft, 1 / rate)
        spectrum = spectrum[:, (bins >= band[0]) & (bins <= band[1])]
    return np.exp(np.log(spectrum).mean(axis=1)) / spectrum.mean(axis=1)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as [start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, int), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def gate(samples: np.ndarray, c: GateConfig | None = None) -> list[tuple[int, int]]:
    """Speech intervals in file-relative ms of 16-bit samples."""
    c = c or GateConfig()
    if len(samples) < c.fft:
        return []
    x = np.asarray(samples, np.float32) / 32768
    energy, flat = rms(x, c.hop, c.fft), flatness(x, c.sample_rate, c.fft, c.hop, band=(c.low_hz, c.high_hz))
    n = min(len(energy), len(flat))
    energy, flat = energy[:n], flat[:n]
    floor = max(c.energy_least, float(np.percentile(energy, c.floor_percentile)) * c.floor_factor)
    on = (flat > c.flat_low) & (flat < c.flat_high) & (energy > floor)
    k = int(c.debounce_s * c.sample_rate / c.hop) | 1
    votes = np.convolve(on.astype(int), np.ones(k, int), mode="same") if n >= k else on * k
    on = votes > k / 2
    held = on.copy()
    for h in range(1, c.hangover_frames + 1):
        held[h:] |= on[:-h]
    ms = 1000 * c.hop / c.sample_rate
    return [(int(a * ms), int(b * ms)) for a, b in runs(held)]


#: Samples of a block of a recurrence.
STRIDE = 64


def recurrence(c: float, b: np.ndarray) -> np.ndarray:
    """y with ``y[i] = c * y[i - 1] + b[i]`` along the last axis, from 0.

    A block of ``STRIDE`` samples is an affine map of what comes into it: blocks are summed up by one matrix of powers of
    ``c``, and what comes into each is the same recurrence over the blocks' ends.
    """
    n = b.shape[-1]
    if n == 0:
        return np.zeros_like(b, np.float64)
    blocks = -(-n // STRIDE)
    own = np.zeros((*b.shape[:-1], blocks * STRIDE))
    own[..., :n] = b
    own = own.reshape(*b.shape[:-1], blocks, STRIDE)
    powers = c ** np.arange(STRIDE + 1)
    lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)[None, :]
    own = own @ np.where(lag >= 0, powers[np.maximum(lag, 0)], 0.0).T
    if blocks > 1:
        before = recurrence(float(c**STRIDE), own[..., -1])[..., :-1]
        own[..., 1:, :] += before[..., None] * powers[1:]
    return own.reshape(*b.shape[:-1], -1)[..., :n]


def band_pass(samples: np.ndarray, rate: int, low: float = 300.0, high: float = 3000.0) -> np.ndarray:
    """First-order high-pass, then low-pass, along the last axis."""
    x = np.asarray(samples, np.float64)
    step = 1 / rate
    up, down = 1 / (2 * np.pi * low), 1 / (2 * np.pi * high)
    a, b = up / (up + step), step / (down + step)
    return recurrence(1 - b, b * recurrence(a, a * np.diff(x, axis=-1, prepend=0.0)))


def _together(arrays: list, f: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray | None]:
    """``f`` of all arrays of about one length at once (what follows an array's end changes nothing before it)."""
    out: list[np.ndarray | None] = [None if x is None else np.zeros(0) for x in arrays]
    sizes: dict[int, list[int]] = {}
    for i, x in enumerate(arrays):
        if x is not None and len(x):
            sizes.setdefault(len(x).bit_length(), []).append(i)
    for own in sizes.values():
        wide = np.zeros((len(own), max(len(arrays[i]) for i in own)))
        for k, i in enumerate(own):
            wide[k, : len(arrays[i])] = arrays[i]
        for k, y in enumerate(f(wide)):
            out[own[k]] = y[: len(arrays[own[k]])]
    return out


def filtered(df: DataFrame, samples: str, rate: int, name: str = "filtered", low: float = 300.0, high: float = 3000.0) -> DataFrame:
    """``df`` with the band-passed ``samples`` as ``name`` (array of double; null stays null), where they are read."""
    kept = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _together(batch.column("_samples").to_pylist(), lambda x: band_pass(x, rate, low, high))
            values = pa.array([None if y is None else y.tolist() for y in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), values], ["_row", name])

    given = df.select(F.struct(*kept).alias("_row"), F.col(samples).cast("array<double>").alias("_samples"))
    schema = f"_row {given.schema['_row'].dataType.simpleString()}, `{name}` array<double>"
    return given.mapInArrow(run, schema).select("_row.*", f"`{name}`")


def voice_check(df: DataFrame, samples: str, probabilities: str, rate: int, frame_ms: int, energy: float, threshold: float = 0.5, least_ms: int = 0) -> DataFrame:
    """``df`` with ``band_rms`` (the energy of ``samples`` in the voice band), ``detector_ms`` (time of the frames whose
    probability reaches ``threshold``) and ``voice``: whether both sensors agree that there is speech.

    Null or empty samples have no energy, null probabilities no time; neither is voice.
    """
    own = filtered(df, samples, rate, "_band")
    square = F.aggregate("_band", F.lit(0.0), lambda s, v: s + v * v)
    own = own.withColumn("band_rms", F.coalesce(F.sqrt(F.try_divide(square, F.size("_band"))), F.lit(0.0))).drop("_band")
    heard = F.coalesce(F.size(F.filter(probabilities, lambda p: p >= threshold)), F.lit(0)).cast("long")
    own = own.withColumn("detector_ms", F.greatest(heard, F.lit(0)) * frame_ms)
    return own.withColumn("voice", (F.col("band_rms") >= energy) & (F.col("detector_ms") > least_ms))


def speech_ms(probabilities: np.ndarray, hop: int, rate: int, threshold: float = 0.5) -> int:
    """Time of the frames at or above the threshold."""
    return int((np.asarray(probabilities) >= threshold).sum() * hop * 1000 / rate)


def framed(df: DataFrame, key: str, samples: str, measure: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(``key``, frame, value) of a framed measure of every array of samples, where it is read; null arrays have no
    frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(np.asarray(x, np.float64)) if x is not None else () for x in batch.column(1).to_pylist()]
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    pa.array([i for k in n for i in range(k)], pa.int32()),
                    pa.array([float(v) for f in found for v in f], pa.float64()),
                ],
                names=[key, "frame", "value"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, samples).mapInArrow(run, f"{key} {kind}, frame int, value double")


def voice(samples: np.ndarray, rate: int, probabilities: np.ndarray, hop: int, c: GateConfig | None = None, least_ms: int = 0) -> bool:
    """Two sensors on one buffer: whether the gate finds speech in the voice band and the detector's frames at or
    above its threshold last longer than ``least_ms``.
    """
    heard = np.clip(band_pass(samples, rate), -32768, 32767)
    return bool(gate(heard, c)) and speech_ms(probabilities, hop, rate) > least_ms


def cut_ms(samples: np.ndarray, rate: int, start_ms: int, end_ms: int) -> np.ndarray:
    """The samples of [start, end), inside the buffer."""
    n = len(samples)
    a, b = (min(max(t * rate // 1000, 0), n) for t in (start_ms, end_ms))
    return samples[a:b]


def duration_ms(n_samples: int, rate: int) -> int:
    return n_samples * 1000 // rate
