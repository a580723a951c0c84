import base64
import hashlib
import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skerry.config import ReorderConfig, StitchConfig
from skerry.functions import plugins
from skerry.operators import nested, streams, tables
from skerry.sources import files, remote
from skerry.streaming import metrics, processors, sinks, topic


class Server(BaseHTTPRequestHandler):
    asked: list = []
    posts: list = []

    def do_GET(self):  # noqa: N802
        self.asked.append((self.path, self.headers.get("Authorization")))
        if self.path == "/none":
            self.send_response(204)
            self.end_headers()
            return
        body = {"/feeds": [{"id": 1}, {"id": 2}], "/days": {"days": [{"day": "2024-01-01"}]}}.get(self.path)
        self.send_response(200 if body else 404)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.posts.append(body["id"])
        status = {"good": 200, "bad": 400, "down": 503}.get(body["id"])
        self.send_response(status or (200 if self.posts.count(body["id"]) == 3 else 500))
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    held = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


def test_rest_listing(spark, server):
    spark.dataSource.register(remote.RestListing)

    def read(field=None, *paths):
        reader = spark.read.format("rest_listing").option("urls", ",".join(server + p for p in paths))
        return (reader.option("field", field) if field else reader).load()

    assert sorted(r.entry for r in read(None, "/feeds", "/none").collect()) == ['{"id": 1}', '{"id": 2}']
    assert [json.loads(r.entry) for r in read("days", "/days").collect()] == [{"day": "2024-01-01"}]
    with pytest.raises(Exception, match="404"):
        read(None, "/lost").collect()
    with pytest.raises(Exception, match="urls"):
        spark.read.format("rest_listing").load().collect()


def test_bearer():
    head, claims, signature = remote.bearer("key", "k1", "app", 1000).split(".")
    assert json.loads(base64.urlsafe_b64decode(claims + "==")) == {"iss": "app", "iat": 1000, "exp": 1060}
    own = base64.urlsafe_b64encode(hmac.new(b"key", f"{head}.{claims}".encode(), hashlib.sha256).digest())
    assert signature == own.rstrip(b"=").decode()


def test_deliver_tries_again_and_swallows(spark, server):
    Server.posts.clear()
    rows = spark.createDataFrame([("good",), ("bad",), ("down",), ("third",)], "id string")
    got = {r.id: (r.status, r.delivered) for r in sinks.deliver(rows, "id", server, base_s=0.001).collect()}
    assert got == {"good": (200, True), "bad": (400, False), "down": (503, False), "third": (200, True)}
    assert [Server.posts.count(k) for k in ("good", "bad", "down", "third")] == [1, 1, 4, 3]


def test_retried():
    waits, calls = [], iter([OSError("a"), OSError("b"), None])

    def call():
        if error := next(calls):
            raise error
        return 5

    assert sinks.retried(call, 3, 1.0, 1.5, sleep=waits.append) == 5 and len(waits) == 2
    assert 0 <= waits[0] <= 1 and 0 <= waits[1] <= 1.5
    with pytest.raises(KeyError):
        sinks.retried(lambda: {}["x"], 5, 1, 1, (OSError,), sleep=waits.append)
    assert len(waits) == 2


def test_append_absent_and_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    topic.append_absent(rows, path, ["k"])
    topic.append_absent(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, topic.read(spark, path, rows.schema).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    sinks.write_csv(rows, str(tmp_path / "c"), "v")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_plugins(spark):
    tone = (8000 * np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)).astype("<i2")
    rows = spark.createDataFrame([(1, tone.tobytes()), (2, None), (3, b"x")], "id int, pcm binary")
    got = {r.id: r for r in plugins.detect(rows).collect()}
    assert set(got[1].asDict()) == {"id", "error", "speech_segments"}
    assert got[2].speech_segments == [] and got[2].error is None
    assert got[3].speech_segments is None and "ValueError" in got[3].error
    for name, settings in (("none", None), ("gate", "{"), ("gate", "[]"), ("gate", '{"other": 1}'), ("gate", '{"hop": 0}')):
        with pytest.raises(ValueError, match="plugin|invalid settings"):
            plugins.detect(rows, name, settings)


def test_transcribers(spark):
    @plugins.register(plugins.TRANSCRIBERS, "lengths")
    def _make(settings):
        def said(samples):
            return f" {len(samples) * settings['factor']} " if len(samples) else " "

        return said

    rows = spark.createDataFrame([(1, b"abcd"), (2, b"")], "id int, pcm binary")
    got = {r.id: r.transcript for r in plugins.transcribe(rows, "lengths", '{"factor": 3}').collect()}
    assert got == {1: "6", 2: None}


def test_metrics(spark):
    rows = [(1, "s", str(i), t, t, i) for i, t in enumerate([0, 15_000, 45_000, 30_000, 10_000])]
    chunks = spark.createDataFrame(
        rows, "feed_id long, session_id string, gcs_uri string, event_ts_ms long, arrival_ts_ms long, seq long"
    )
    seen = Observation("reorder")
    metrics.reorder_metrics(streams.reorder(chunks), seen).collect()
    assert seen.get == {"ordered": 3, "drained": 1, "gap": 0, "late": 1, "discarded": 0}


def test_streaming_totals(spark, tmp_path):
    held = metrics.Totals()
    spark.streams.addListener(held)
    for i in range(3):
        spark.createDataFrame([("gap", i), ("late", i)], "kind string, audio_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, audio_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.observe("m", *metrics.counters("kind", "gap", "late"), *metrics.distribution("audio_ms"))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(held)
    assert held.values["m"] == {
        "gap": 3, "late": 3, "audio_ms_n": 6, "audio_ms_sum": 6, "audio_ms_min": 0, "audio_ms_max": 2,
        "audio_ms_p50": 2.0, "audio_ms_p90": 2.0, "audio_ms_p99": 2.0,
    }


def test_region_segments(spark):
    schema = (
        "audio string, annotations array<struct<result: array<struct<id: string, type: string, start: double, end: double, "
        "texts: array<string>>>>>"
    )
    region, said = ("a", "labels", 1.0, 2.0, None), ("a", "textarea", None, None, [" x ", "y"])
    rows = [
        ("one", [([region, said],), ([("b", "audioregion", 0.0, 1.0, None), ("b", "textarea", None, None, ["z"])],)]),
        ("other annotation", [([region],), ([said],)]),
        ("no time", [([("a", "labels", None, 2.0, None), said],)]),
        ("blank", [([region, ("a", "textarea", None, None, [" "])],)]),
        ("last", [([region, said, ("a", "textarea", None, None, []), ("a", "textarea", None, None, ["new"])],)]),
        ("", [([region, said],)]),
        (None, [([region, said],)]),
        ("nothing", None),
        ("empty", [(None,)]),
    ]
    got = nested.region_segments(spark.createDataFrame(rows, schema), "audio", "annotations").collect()
    assert {r.audio_path: [tuple(s) for s in r.segments] for r in got} == {
        "one": [(1.0, 2.0, "x"), (0.0, 1.0, "z")],
        "last": [(1.0, 2.0, "new")],
    }


def test_filename_prefixes(spark, tmp_path):
    output = 'outputs: (\n{{\n type = "{kind}"\n filename_template = "{name}"\n}}\n)'
    files_ = [("file", "one"), ("file", "one"), ("file", "two_tones"), ("icecast", "three"), ("file", "four")]
    body = "\n".join(output.format(kind=k, name=n) for k, n in files_)
    after = output.format(kind="file", name="outside")
    (tmp_path / "a.conf").write_text(f"x = (1);\ndevices:\n(\n{body}\n);\nother: ( {after} )")
    (tmp_path / "b.conf").write_text(f"devices:\n(\n{body}")
    (tmp_path / "c.conf").write_text("nothing")
    got = files.filename_prefixes(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.filename_template) for r in got) == [("a.conf", "four"), ("a.conf", "one")]


def test_object_sizes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    asked = spark.createDataFrame([("d/x.bin",), ("d/lost",)], "path string")
    assert sorted(map(tuple, files.object_sizes(spark, asked, str(tmp_path)).collect())) == [("d/lost", None), ("d/x.bin", 3)]


def test_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "broken")], "id int, error string")
    for _ in range(2):  # a batch that is replayed
        sinks.fan_out(rows, str(tmp_path / "o"), str(tmp_path / "d"), 7)
    assert [tuple(r) for r in topic.read(spark, str(tmp_path / "o"), "id int").collect()] == [(1,)]
    assert [tuple(r) for r in topic.read(spark, str(tmp_path / "d"), rows.schema).collect()] == [(2, "broken")]


def test_claim_check(spark, tmp_path):
    t = np.arange(16_000) / 16_000
    tone = (8000 * np.sin(2 * np.pi * 700 * t) * (t > 0.3)).astype(np.int16)
    for name, samples in (("a", tone), ("b", np.zeros(100, np.int16))):
        (tmp_path / f"{name}.pcm").write_bytes(samples.tobytes())
    uris = [(1, f"file://{tmp_path}/a.pcm"), (2, f"file:{tmp_path}/b.pcm"), (3, f"file://{tmp_path}/c.pcm"), (4, None), (1, f"file://{tmp_path}/a.pcm")]
    rows = spark.createDataFrame(uris, "feed long, uri string")
    found = files.claim_check(rows, "uri", spark.read.format("binaryFile").load(f"{tmp_path}/*.pcm"))
    lost = tables.dead_letters(found.drop("content"), F.col("feed"), "download").collect()
    assert {(r.feed_id, r.error) for r in lost} == {("3", "object not found"), ("4", "object not found")}
    heard = files.detect(found.where("error IS NULL")).collect()
    assert sorted((r.feed, r.duration_ms) for r in heard) == [(1, 1000), (1, 1000), (2, 6)]
    assert all(r.speech_segments == [] for r in heard if r.feed == 2)


def _rows_of(query, name, spark, n, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.sql(f"SELECT * FROM {name}").collect()
        if len(rows) >= n or query.exception():
            return rows
        time.sleep(0.5)
    return rows


CHUNK = (
    "feed_id long, session_id string, gcs_uri string, event_ts_ms long, duration_ms long, "
    "speech_segments array<struct<start_ms: long, end_ms: long>>, seq long"
)


def test_live_transmissions(spark, tmp_path):
    """Out of order, with a gap, and with a stale end: the live processor says what the batch kernels say."""
    chunks = [(1, "s", f"u{i}", i * 15_000, 15_000, [(0, 15_000)], i) for i in (0, 2, 1)]
    chunks += [(1, "s", "u3", 45_000, 15_000, [], 3), (1, "s", "u4", 60_000, 15_000, [(5_000, 9_000)], 4)]
    chunks += [(2, "s", "v0", 0, 15_000, [(1_000, 2_000)], 0)]
    rows = spark.createDataFrame([(*c[:6], k) for k, c in enumerate(chunks)], CHUNK)
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stitching = StitchConfig(gap_ms=3_000, stale_ms=4_000)
    stream = spark.readStream.schema(CHUNK).json(str(tmp_path / "in"))
    found = processors.transmissions_stream(stream, ReorderConfig(timeout_ms=2_000), stitching)
    query = (
        found.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(processingTime="500 milliseconds").start()
    )
    try:
        live = _rows_of(query, "live", spark, 3)
        assert not query.exception()
    finally:
        query.stop()
    got = {(r.feed_id, tuple(r.contributing_audio_uris), r.reason) for r in live}
    assert {(f, u) for f, u, _ in got} == {(1, ("u0", "u1", "u2", "u3")), (1, ("u4",)), (2, ("v0",))} or {
        (f, u) for f, u, _ in got
    } == {(1, ("u0", "u1", "u2")), (1, ("u4",)), (2, ("v0",))}
    assert {r for f, u, r in got if u in (("u4",), ("v0",))} == {"stale"}


def test_stale_deadline_is_not_prolonged():
    """A reorder timer that fires in between leaves the stale deadline where it was."""
    timers, held = set(), {}

    class State:
        def exists(self):
            return bool(held)

        def get(self):
            return held["v"]

        def update(self, v):
            held["v"] = v

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        def listTimers(self):  # noqa: N802
            return iter(sorted(timers))

        def deleteTimer(self, t):  # noqa: N802
            timers.discard(t)

        def registerTimer(self, t):  # noqa: N802
            timers.add(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.ms

    def chunk(i, seq, speech=((0, 9_000),)):
        own = [{"start_ms": a, "end_ms": b} for a, b in speech]
        return pd.DataFrame([{"session_id": "s", "gcs_uri": f"u{i}", "event_ts_ms": i * 15_000, "duration_ms": 15_000, "speech_segments": own, "seq": seq}])

    p = processors.Transmissions(ReorderConfig(), StitchConfig(gap_ms=800))
    p.init(Handle())
    list(p.handleInputRows((1,), iter([chunk(0, 0)]), Now(1_000)))
    assert timers == {46_000}
    list(p.handleInputRows((1,), iter([chunk(5, 1, ())]), Now(20_000)))  # waits: chunks 1 to 4 are missing
    assert timers == {35_000, 46_000}
    list(p.handleExpiredTimer((1,), Now(35_000), None))  # silence after a hole
    rest = [r for f in p.handleExpiredTimer((1,), Now(46_000), None) for r in f.to_dict("records")]
    assert not timers or max(timers) <= 46_000 and not rest


def test_exactly_once(spark, tmp_path):
    schema = "chunk_uri string, event_ts timestamp, n int"
    for name, rows in (("1", ["a", "a", "b"]), ("2", ["b", "c"])):
        lines = [json.dumps({"chunk_uri": u, "event_ts": f"2024-01-01T00:0{name}:00Z", "n": i}) for i, u in enumerate(rows)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = (
        processors.exactly_once(stream).writeStream.format("memory").queryName("once")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert sorted(r.chunk_uri for r in spark.sql("SELECT * FROM once").collect()) == ["a", "b", "c"]
    table = spark.read.schema(schema).json(str(tmp_path / "*.json"))
    assert {r.chunk_uri for r in streams.first_of(table, ["chunk_uri"], "event_ts").collect()} == {"a", "b", "c"}
