import struct
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skerry.config import GateConfig
from skerry.functions import audio, signal
from skerry.operators import quantiles, tables
from skerry.sources import files
from skerry.streaming import metrics


def _wav(samples, rate, bits=16, channels=1, kind=1, extra=b"", extensible=False):
    """A file of float samples (-1 to 1), the same on all channels but for the first, which carries them all."""
    x = np.repeat(np.asarray(samples)[:, None], channels, axis=1)
    if kind == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = np.clip(np.rint(x * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    else:
        whole = np.rint(x * (2 ** (bits - 1) - 1)).astype("<i4")
        body = whole.reshape(-1).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    code = 0xFFFE if extensible else kind
    head = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        head += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + b"\0" * 14
    parts = b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in ((b"LIST", extra), (b"fmt ", head), (b"data", body)) if b or k != b"LIST")
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


@pytest.mark.parametrize("bits, kind", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)])
@pytest.mark.parametrize("channels, extensible", [(1, False), (2, True), (3, False)])
def test_wav(bits, kind, channels, extensible):
    x = 0.7 * np.sin(np.arange(1001) / 9)
    rate, got = audio.read_wav(_wav(x, 22_050, bits, channels, kind, b"odd", extensible))
    assert rate == 22_050 and len(got) == 1001
    assert np.abs(got / 32768 - x).max() < (0.01 if bits == 8 else 1e-4)


def test_broken_wavs():
    whole = _wav(np.zeros(100), 8000)
    for data in (b"RIFF", b"RIFFxxxxWAVE", whole[:30], whole[:36], whole.replace(b"data", b"dada"), whole.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 7, 1), 1)):
        with pytest.raises(ValueError, match="WAV"):
            audio.read_wav(data)
    assert len(audio.read_wav(whole[:-50])[1]) == 75  # cut off
    assert len(audio.read_wav(_wav(np.zeros(0), 8000))[1]) == 0


@pytest.mark.parametrize("rate", [8000, 11_025, 22_050, 44_100, 48_000, 16_001])
def test_resampling_keeps_tones_and_drops_what_is_too_high(rate):
    t = np.arange(rate) / rate
    got = audio.resample(np.sin(2 * np.pi * 700 * t), rate, 16_000)
    assert len(got) == 16_000
    want = np.sin(2 * np.pi * 700 * np.arange(16_000) / 16_000)
    assert np.abs(got - want)[200:-200].max() < 2e-3
    if rate > 20_000:
        high = audio.resample(np.sin(2 * np.pi * 10_000 * t), rate, 16_000)
        assert np.abs(high)[200:-200].max() < 2e-2


def test_files_of_any_rate_are_heard_alike(spark, tmp_path):
    def sound(rate):
        t = np.arange(2 * rate) / rate
        said = (t > 0.5) & (t < 1.2)
        return 0.3 * np.sin(2 * np.pi * 700 * t) * said + 0.2 * np.sin(2 * np.pi * 1100 * t) * said

    config = GateConfig(flat_low=0.0)
    want = signal.gate(np.rint(sound(16_000) * 32767), config)
    assert want
    cases = {"a": (16_000, 16, 1), "b": (8000, 16, 2), "c": (44_100, 24, 1), "d": (48_000, 32, 2), "e": (22_050, 16, 1)}
    for name, (rate, bits, channels) in cases.items():
        (tmp_path / f"{name}.wav").write_bytes(_wav(sound(rate), rate, bits, channels))
    (tmp_path / "raw.wav").write_bytes(np.rint(sound(16_000) * 32767).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVEfmt ")
    names = [*cases, "raw", "bad", "lost"]
    rows = spark.createDataFrame([(i, f"file://{tmp_path}/{n}.wav") for i, n in enumerate(names)], "feed long, uri string")
    found = files.detect(files.claim_check(rows, "uri", spark.read.format("binaryFile").load(f"{tmp_path}/*.wav")), config=config).cache()
    got = {names[r.feed]: r for r in found.collect()}
    for name in [*cases, "raw"]:
        assert got[name].duration_ms == 2000 and got[name].error is None
        heard = [(s.start_ms, s.end_ms) for s in got[name].speech_segments]
        assert len(heard) == len(want) and all(abs(x - y) <= 40 for a, b in zip(heard, want, strict=True) for x, y in zip(a, b, strict=True)), name
    lost = tables.dead_letters(found, F.col("feed"), "detect").collect()
    assert {(names[int(r.feed_id)], r.error) for r in lost} == {("bad", "WAV file without a format"), ("lost", "object not found")}


def _loop(samples, rate, low=300.0, high=3000.0):
    step, up, down = 1 / rate, 1 / (2 * np.pi * low), 1 / (2 * np.pi * high)
    a, b = up / (up + step), step / (down + step)
    out, high_y, low_y, before = [], 0.0, 0.0, 0.0
    for v in samples:
        high_y = a * (high_y + v - before)
        before = v
        low_y += b * (high_y - low_y)
        out.append(low_y)
    return np.array(out)


def test_filters_equal_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 4097, 20_000):
        x = rng.normal(0, 10_000, n)
        assert np.abs(signal.band_pass(x, 16_000) - _loop(x, 16_000)).max(initial=0) < 1e-9 * 10_000
    x = rng.normal(0, 1, (50, 16_000))
    began = time.perf_counter()
    signal.band_pass(x, 16_000)
    fast = (time.perf_counter() - began) / 50
    began = time.perf_counter()
    _loop(x[0], 16_000)
    assert time.perf_counter() - began > 10 * fast  # about 20 to 60 times on a machine of its own
    arrays = [None, [], [1.0], rng.normal(0, 1, 300).tolist(), rng.normal(0, 1, 70).tolist()]
    df = spark.createDataFrame([(i, a, "kept") for i, a in enumerate(arrays)], "id long, x array<double>, filtered string")
    for r in signal.filtered(df, "x", 16_000).collect():
        want = arrays[r.id]
        assert (r.filtered is None) == (want is None)
        assert want is None or np.allclose(r.filtered, _loop(want, 16_000), atol=1e-9)


def test_both_sensors_have_to_agree(spark):
    t = np.arange(16_000) / 16_000
    tone, low = np.sin(2 * np.pi * 700 * t).tolist(), np.sin(2 * np.pi * 20 * t).tolist()
    rows = [(1, tone, [0.9] * 10), (2, tone, [0.1] * 10), (3, low, [0.9] * 10), (4, None, [0.9] * 10), (5, tone, None), (6, [], []), (7, [0.0] * 16_000, [0.9] * 10)]
    df = spark.createDataFrame(rows, "id long, x array<double>, p array<double>")
    seen = Observation("detector")
    checked = signal.voice_check(df, "x", "p", 16_000, 16, 0.3, 0.5, 100)
    got = {r.id: r for r in metrics.detector_metrics(checked, to=seen).collect()}
    assert [got[i].voice for i in range(1, 8)] == [True, False, False, False, False, False, False]
    assert got[1].detector_ms == 160 and got[5].detector_ms == 0
    assert seen.get["speech"] == 1 and seen.get["silence"] == 6 and seen.get["speech_ms_p50"] == 160


def test_framed_energy_of_short_arrays():
    assert len(signal.rms(np.zeros(0), 4, 16)) == 0
    assert np.allclose(signal.rms(np.array([1.0, 2, 3, 4, 5]), 4, 16), [3.2404, 3.2404], atol=1e-4)
    assert len(signal.rms(np.ones(8), 4, 16)) == 3
    assert np.allclose(signal.rms(np.array([2.0]), 4, 16), [2.0])


@pytest.mark.parametrize("plain", [10, 1 << 20])
def test_quantiles(spark, monkeypatch, plain):
    monkeypatch.setattr(quantiles, "PLAIN", plain)
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in ((1, 6000), (None, 300), (2, 1), (4, 2)) for v in np.round(rng.normal(0, 5, n), 1)]
    rows += [(1, None), (1, float("nan")), (3, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(4)
    for q in (0.0, 0.1, 0.5, 0.997, 1.0):
        got = {r.k: r for r in quantiles.exact_quantile(df, ["k"], "v", q).collect()}
        for k in (1, None, 2, 4):
            own = [v for key, v in rows if key == k and v is not None and v == v]
            assert got[k].n == len(own) and abs(got[k].quantile - np.quantile(own, q)) < 1e-9, (k, q)
        assert got[3].n == 0 and got[3].quantile is None
    # bounds that miss the rank: that group is done again
    monkeypatch.setattr(quantiles, "quantile", lambda sketch, q: F.lit(1e9))
    again = {r.k: r.quantile for r in quantiles.exact_quantile(df, ["k"], "v", 0.5).collect()}
    assert abs(again[1] - np.quantile([v for k, v in rows if k == 1 and v is not None and v == v], 0.5)) < 1e-9


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 50_000).cast("double").alias("v"))
    whole = quantiles.merged(quantiles.sketches(df, ["k"], "v"), []).select("n", quantiles.quantile(F.col("sketch"), 0.3).alias("q")).first()
    assert whole.n == 50_000 and abs(whole.q - 15_000) <= 50_000 * quantiles.RANK_ERROR


def test_counts_of_dead_letters_and_transcripts(spark):
    letters = spark.createDataFrame([("f", "e", "t", "download", "{}"), ("f", "e", "t", "parse", "{}"), ("f", "e", "t", "parse", "{}")], "feed_id string, error string, error_type string, stage string, body string")
    seen = Observation("letters")
    metrics.dead_letter_metrics(letters, ("download", "parse", "stitch"), seen).collect()
    assert seen.get == {"dead_letters": 3, "download": 1, "parse": 2, "stitch": 0}
    done = spark.createDataFrame([("hi", 5.0, None), (" \n", 7.0, None), (None, 9.0, None), (None, None, "broken")], "text string, took_ms double, error string")
    seen = Observation("said")
    metrics.transcription_metrics(done, to=seen).collect()
    got = seen.get
    assert (got["transcribed"], got["blank"], got["failed"], got["transcription_time_ms_n"]) == (1, 2, 1, 3)
    assert got["transcription_time_ms_p50"] == 7.0 and got["transcription_time_ms_max"] == 9.0
