"""WAV files as samples of one channel at one rate, in numpy: what tasks do with the contents of a ``binaryFile`` scan."""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

# Codes of the container's sample formats.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the resampling filter on each side, and output samples that are made at once.
CROSSINGS, STEP = 24, 1 << 15
FULL = 32768.0


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each kind of a RIFF/WAVE file; one that is cut off has what is left."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    found: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        found.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def read_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples): all channels mixed to one, in the range of 16 bits.  8, 16, 24 and 32 bits and floats."""
    found = chunks(data)
    head = found.get(b"fmt ", b"")
    if len(head) < 16:
        raise ValueError("WAV file without a format")
    if b"data" not in found:
        raise ValueError("WAV file without data")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
    if kind == EXTENSIBLE and len(head) >= 26:
        kind = struct.unpack_from("<H", head, 24)[0]
    if not channels or not rate:
        raise ValueError("WAV file without channels or rate")
    width = bits // 8
    if (kind, bits) not in [(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)]:
        raise ValueError(f"WAV format {kind} with {bits} bits")
    body = found[b"data"]
    raw = np.frombuffer(body, np.uint8, len(body) // (width * channels) * width * channels)
    if kind == FLOAT:
        values = raw.view(f"<f{width}").astype(np.float64) * FULL
    elif bits == 8:
        values = (raw.astype(np.float64) - 128) * 256
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)  # the sign ends up in the highest byte
        values = wide.reshape(-1).view("<i4") / 65536.0
    return rate, values.reshape(-1, channels).mean(axis=1)


@lru_cache(8)
def _phases(up: int, down: int) -> np.ndarray:
    """The taps of each of ``up`` phases: a sinc below both rates' half, under a Kaiser window."""
    wide = max(1.0, down / up)
    half = math.ceil(CROSSINGS * wide)
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(at / wide) * np.i0(9.0 * np.sqrt(np.maximum(0, 1 - (at / half) ** 2))) / np.i0(9.0)
    return taps / taps.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by a polyphase filter; silence before and after."""
    x = np.asarray(samples, np.float64)
    if rate == to or not len(x):
        return x
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    taps = _phases(up, down)
    half = taps.shape[1] // 2
    padded = np.concatenate((np.zeros(half - 1), x, np.zeros(half + 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps.shape[1])
    n = -(-len(x) * up // down)
    out = np.empty(n)
    for a in range(0, n, STEP):
        place = np.arange(a, min(a + STEP, n)) * down
        out[a : a + STEP] = np.einsum("ij,ij->i", windows[place // up], taps[place % up])
    return out


def samples_at(data: bytes, rate: int) -> tuple[np.ndarray, int]:
    """(16-bit samples of one channel at ``rate``, duration in ms) of a WAV file or of such samples without a header."""
    if data[:4] != b"RIFF":
        raw = np.frombuffer(data, "<i2", len(data) // 2)
        return raw, len(raw) * 1000 // rate
    own, values = read_wav(data)
    at_rate = np.clip(np.rint(resample(values, own, rate)), -FULL, FULL - 1).astype(np.int16)
    return at_rate, len(values) * 1000 // own
