import json
import random
import time

import pytest
from pyspark.sql import functions as F

from skerry.functions import kernels
from skerry.operators import nested, tables, words
from skerry.sources import files
from skerry.streaming import processors


def test_alignment_in_batches_equals_one_by_one():
    rng = random.Random(1)
    texts = [[" ".join(rng.choices("abcd", k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(300)] for _ in range(2)]
    texts[0] += ["a " * 700, "", "x"]
    texts[1] += ["b a " * 300, "y", ""]
    got = words.counts(*texts)
    for r, s, own in zip(*texts, got.tolist(), strict=True):
        assert tuple(own) == kernels.align(r.split(), s.split())
    assert words.counts([], []).shape == (0, 4)


def test_lookups_keep_the_left_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, v string")
    got = tables.with_default(left, right, "k", "v", F.lit("-")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "b", False), (1, "b", False), (2, "-", True), (None, "-", True)], key=str)


def test_last_of_equal_orders(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (1, 4, "z"), (2, None, "n"), (2, None, "m")], "k int, at int, v string")
    assert sorted(map(tuple, nested.last_wins(rows.repartition(3), "k", "at").collect())) == [(1, 5, "c"), (2, None, "n")]


def test_broken_constraints(spark):
    feeds = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "x", "b"), (4, "x", "a"), (5, "y", None)], "id int, name string, source_type string")
    sources = spark.createDataFrame([("a",), ("a",)], "slug string")
    got = sorted(map(tuple, tables.violations(feeds, sources).collect()))
    assert got == [
        (1, "null name"), (2, "null name"), (3, "name not unique"), (3, "unknown source type"), (4, "name not unique"), (5, "unknown source type"),
    ]


def test_labels_to_manifests(spark, tmp_path):
    def region(text, start=1.0, end=2.5, name="transcription"):
        value = {"start": start, "end": end, "text": text}
        return {"id": "r", "from_name": name, "value": {k: v for k, v in value.items() if v is not None}}

    tasks = [
        {"data": {"audio": "/data/a/x.flac"}, "annotations": [{"result": [region(["one"]), region(["\n\t"]), region([]), region(["zero"], 2.5)]}, {"result": [region(["later"])]}]},
        {"data": {"audio": "/data//abs.flac"}, "annotations": [{"result": [region(["two"], None, 0.12345), region(["no"], name="labels")]}]},
        {"data": {"audio": "/data/none.flac"}, "annotations": []},
    ]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(tasks))
    got = files.labelled_segments(spark, str(path), "/data/", "gs://b/audio")
    assert sorted(map(tuple, got.collect())) == [
        ("/abs.flac", 0.0, 0.1234, "two", "en") if round(0.12345, 4) == 0.1234 else ("/abs.flac", 0.0, 0.1235, "two", "en"),
        ("gs://b/audio/a/x.flac", 1.0, 1.5, "one", "en"),
    ]
    assert files.labelled_segments(spark, str(path), "/data/").where("audio_filepath = '/data/a/x.flac'").count() == 1
    for broken, says in (({"data": {"audio": "/other/x"}, "annotations": [{"result": [region(["a"])]}]}, "outside"), ({"data": {"audio": "/data/x"}, "annotations": [{"result": [region(["a", "b"])]}]}, "more than one")):
        path.write_text(json.dumps([broken]))
        with pytest.raises(Exception, match=says):
            files.labelled_segments(spark, str(path), "/data/").collect()


def test_result_files(spark, tmp_path):
    said = [{"alternatives": [{"transcript": t}]} for t in (" one [BACKGROUND]", "\n\t", "two ")]
    (tmp_path / "transcripts_ex__seg007.json").write_text(json.dumps({"results": [*said, {}]}))
    (tmp_path / "transcripts_ex__seg008.json").write_text(json.dumps({"results": []}))
    got = sorted(map(tuple, files.transcripts(spark, str(tmp_path)).collect()), key=str)
    assert got == [("ex", "007", "one two"), ("ex", "008", None)]


def test_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"Radio 1", north\n\'Radio 2\',south\nshort\n')
    assert sorted(map(tuple, files.stream_list(spark, str(tmp_path / "s.csv")).collect())) == [("Radio 1", "north"), ("Radio 2", "south")]
    (tmp_path / "u.txt").write_text("https://x.org/a/b.mp3?k=1\n# no\nhttp://y.org//c.mp3 \n")
    assert sorted(r.path for r in files.url_paths(spark, str(tmp_path / "u.txt")).collect()) == ["a/b.mp3", "c.mp3"]
    rows = spark.createDataFrame([("a", 1.5)], "text string, offset double")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path / "m"), "text string, offset double").collect()] == [("a", 1.5)]


SCHEMA = "id string, ts_ms long"


def test_dedup_state_expires(spark, tmp_path):
    """After its time to live an id is let through again, though its own time hardly moved: nothing of it is left."""
    source, ttl = tmp_path / "in", 15_000
    source.mkdir()

    def add(name, *rows):
        (source / f"{name}.tmp").write_text("\n".join(json.dumps({"id": i, "ts_ms": t}) for i, t in rows) + "\n")
        (source / f"{name}.tmp").rename(source / f"{name}.json")

    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.json").json(str(source))
    found = processors.dedup_stream(stream, "id", ttl, expiring=True)
    query = (
        found.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(processingTime="300 milliseconds").start()
    )

    def wait(done):
        end = time.time() + 40
        while not done() and time.time() < end and not query.exception():
            time.sleep(0.3)
        assert done() and not query.exception()

    def rows():
        return sorted(map(tuple, spark.table("expiring").collect()))

    try:
        add("1", ("a", 0), ("b", 0))
        wait(lambda: len(rows()) == 2)
        add("2", ("a", 1), ("d", 1))
        wait(lambda: ("d", 1) in rows())
        assert rows() == [("a", 0), ("b", 0), ("d", 1)]
        time.sleep(1.3 * ttl / 1000)  # timers fire in batches without rows
        add("3", ("c", 2))
        wait(lambda: ("c", 2) in rows())
        add("4", ("a", 3))
        wait(lambda: ("a", 3) in rows())
        assert rows() == [("a", 0), ("a", 3), ("b", 0), ("c", 2), ("d", 1)]
    finally:
        query.stop()
    held = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "cp"))
    assert "b" not in {r.key[0] for r in held.collect()}


def test_a_chunk_and_its_repeat_keep_their_own_data():
    """Both wait in the buffer; what came first goes first, and neither goes on without its length."""
    own = object.__new__(processors.Transmissions)
    meta = {"u": [(15_000, [(0, 100)]), (15_000, [(0, 100)])]}
    seen = []

    class Stitch:
        def on_chunk(self, uri, ts, length, segments):
            seen.append((uri, length, segments))
            return []

    ready = [{"gcs_uri": "u", "event_ts_ms": 0, "kind": "drained"}, {"gcs_uri": "u", "event_ts_ms": 0, "kind": "late"}]
    own._stitched((1,), ready, Stitch(), meta)
    assert seen == [("u", 15_000, [(0, 100)])] * 2 and not meta


def test_chunk_messages_have_one_reason_in_order(spark):
    whole = {"start_timestamp": {"seconds": 5, "nanos": 250_000_000}, "gcs_uri": "u", "session_id": "s"}
    cases = [
        (json.dumps(whole), None, 5.25),
        (json.dumps(whole | {"start_timestamp": {}}), None, 0.0),
        (json.dumps({"gcs_uri": ""}), "missing start_timestamp", None),
        (json.dumps(whole | {"gcs_uri": "", "session_id": None}), "missing gcs_uri", None),
        (json.dumps(whole | {"session_id": ""}), "missing session_id", None),
        ("{", "failed to parse chunk", None),
        ("", "failed to parse chunk", None),
        (None, "failed to parse chunk", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "feed_id int, body string")
    found = tables.chunk_events(df)
    got = {r.feed_id: (r.error, r.event_time_s) for r in found.collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    letters = tables.dead_letters(found, F.col("feed_id"), "parse").collect()
    assert len(letters) == 6 and all(r.error for r in letters)
    assert tables.chunk_events(df.limit(0)).count() == 0


def test_unset_payload_fields_are_zero(spark):
    rows = spark.createDataFrame([("a", None, 5, None, None, None), ("b", 0, None, 7, True, ["r"])], "id string, start_ms long, end_ms long, start_audio_offset_ms long, missing_prior_context boolean, decisions array<string>")
    got = sorted(map(tuple, tables.evaluated_payload(rows).collect()))
    assert got == [("a", 0, 5, 0, False, []), ("b", 0, 0, 7, True, ["r"])]


def test_every_constraint(spark):
    schema = "id long, name string, source_type string, status string, failure_count int, created_at int"
    rows = [(1, "a", "x", "active", 0, 1), (1, "b", "x", "active", 0, 1), (None, None, None, None, None, None), (2, "a", "y", "odd", 0, 1)]
    feeds, sources = spark.createDataFrame(rows, schema), spark.createDataFrame([("x",)], "slug string")
    properties = spark.createDataFrame([(1, "u"), (2, None), (9, "u")], "feed_id long, stream_url string")
    got = sorted(map(tuple, tables.all_violations(feeds, sources, properties).collect()), key=str)
    none = ("null id", "null name", "null source type", "null status", "null failure count", "null creation time")
    want = [(1, "id not unique")] * 2 + [(1, "name not unique"), (2, "name not unique"), (2, "unknown source type"), (2, "unknown status"), (2, "null stream url"), (9, "properties of no feed")]
    assert got == sorted(want + [(None, n) for n in none], key=str)
