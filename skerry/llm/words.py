"""Word hashes of many texts at once, in numpy over Arrow's own buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

BASE = 0x9E3779B97F4A7C15
WINDOW = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n, WINDOW) + 1
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text bounds) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    bounds, at = buffers(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, min(end, len(texts))
        at = end


def release() -> None:
    """Give freed memory back to the system, so that a worker doesn't carry one stage's peak into the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[upper] += 32
    return out


def _windows(is_word: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut long buffers where no word is."""
    at, n = 0, len(is_word)
    while at < n:
        end = at + WINDOW
        while end < n and is_word[end] and is_word[end - 1] and end != bounds[np.searchsorted(bounds, end)]:
            gap = np.flatnonzero(~is_word[end : end + WINDOW])
            end = end + (int(gap[0]) if len(gap) else WINDOW)
        yield at, min(end, n)
        at = end


def hash_words(
    data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row 0 has a hash per word, row k one of its first ``prefixes[k - 1]`` bytes; the words
    of text i are columns ``first[i]`` to ``first[i + 1]``.  Words are maximal runs of ``word_bytes``.
    """
    found: list[np.ndarray] = [np.zeros((1 + len(prefixes), 0), np.uint64)]
    places: list[np.ndarray] = [np.zeros(0, np.int64)]
    is_word = word_bytes[data]
    for a, b in _windows(is_word, bounds):
        own, part = is_word[a:b], data[a:b]
        inner = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
        before, after = np.zeros(b - a, bool), np.zeros(b - a, bool)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[inner] = False
        after[inner[inner > 0] - 1] = False
        starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
        up, down = _power_tables(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        origin = down[starts]
        rows = [mix((sums[ends] - sums[starts]) * origin)]
        for k, p in enumerate(prefixes):
            rows.append(mix((sums[np.minimum(ends, starts + p)] - sums[starts]) * origin + np.uint64(k + 1)))
        found.append(np.stack(rows))
        places.append(starts + a)
    return np.concatenate(found, axis=1), np.searchsorted(np.concatenate(places), bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text of each): every run of ``k`` words; a shorter text that has words is one shingle."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), counts)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    starts = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = first[1:][owner]
    out = np.zeros(len(owner), np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    for i in range(k):
        word = padded[starts + i]
        out = out * np.uint64(BASE) + np.where(starts + i < ends, word, np.uint64(i + 1))
    return mix(out), owner
