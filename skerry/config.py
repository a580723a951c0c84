"""Settings with their checks."""

from __future__ import annotations

from dataclasses import dataclass

CHUNK_MS = 15_000


@dataclass(frozen=True)
class ReorderConfig:
    chunk_ms: int = CHUNK_MS
    tolerance_ms: int = 500
    timeout_ms: int = 15_000


@dataclass(frozen=True)
class StitchConfig:
    gap_ms: int = 800
    stale_ms: int = 45_000
    max_ms: int = 600_000
    pre_roll_ms: int = 1_000
    post_roll_ms: int = 1_000
    chunk_ms: int = CHUNK_MS
    tolerance_ms: int = 0

    def __post_init__(self) -> None:
        if min(self.gap_ms, self.stale_ms, self.max_ms) <= 0:
            raise ValueError("gap, stale and max durations must be positive")
        if self.gap_ms >= self.max_ms:
            raise ValueError("the gap must be shorter than the longest transmission")


def check_timeouts(reorder: ReorderConfig, stitch: StitchConfig) -> None:
    if reorder.timeout_ms >= stitch.stale_ms:
        raise ValueError("the reorder timeout must be shorter than the stale timeout")


@dataclass(frozen=True)
class LeaseConfig:
    limit: int = 250
    abandoned_s: int = 60
    threshold: int = 5
    base_s: int = 15
    cap_s: int = 600


@dataclass(frozen=True)
class GateConfig:
    """The acoustic gate over framed energy and spectral flatness."""

    sample_rate: int = 16_000
    fft: int = 2048
    hop: int = 320
    low_hz: float = 300.0
    high_hz: float = 3400.0
    flat_low: float = 0.005
    flat_high: float = 0.4
    energy_least: float = 0.025
    floor_percentile: float = 10.0
    floor_factor: float = 2.5
    debounce_s: float = 0.2
    hangover_frames: int = 3

    def __post_init__(self) -> None:
        if self.sample_rate <= 0 or self.hop <= 0:
            raise ValueError("sample rate and hop must be positive")
        if self.fft < 256 or self.fft & (self.fft - 1):
            raise ValueError("the FFT size must be a power of two of at least 256")
        if not 0 <= self.low_hz < self.high_hz <= self.sample_rate / 2:
            raise ValueError("the band must lie below half the sample rate")
        if self.sample_rate / self.fft > self.high_hz - self.low_hz:
            raise ValueError("the band must hold at least one bin")
        if not 0 <= self.flat_low < self.flat_high <= 1:
            raise ValueError("flatness bounds must be ascending within 0 and 1")
        if self.energy_least < 0 or self.floor_factor < 0 or not 0 <= self.floor_percentile <= 100:
            raise ValueError("energy settings out of range")
        if self.debounce_s < 0 or self.hangover_frames < 0:
            raise ValueError("debounce and hangover must not be negative")
