import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import catalogue
from skerry.config import GateConfig, ReorderConfig, StitchConfig, check_timeouts
from skerry.functions import columns, signal
from skerry.functions.kernels import Reorder, Stitch, TtlFirst, align
from skerry.operators import rules, streams, tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations labels"


def _values(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([None if x != x else x for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_says_what_sql_says(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _values(ours) == _values(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


C = ReorderConfig(chunk_ms=3000, timeout_ms=5000)


@pytest.mark.parametrize(
    ("expected", "waiting", "now", "after", "out", "kept"),
    [
        (None, [], 1000, 4000, [1000], 0),
        (4000, [], 4000, 7000, [4000], 0),
        (4000, [], 7000, 4000, [], 1),
        (4000, [(7000, "b"), (10000, "c"), (16000, "d")], 4000, 13000, [4000, 7000, 10000], 1),
        (10000, [], 1000, 10000, [1000], 0),
        (4000, [], 3990, 6990, [3990], 0),
    ],
)
def test_reorder(expected, waiting, now, after, out, kept):
    kernel = Reorder(C, {"session": "s", "expected": expected, "waiting": waiting, "due": None})
    assert [r["event_ts_ms"] for r in kernel.on_chunk(now, "a", "s", 0)] == out
    assert kernel.s["expected"] == after and len(kernel.s["waiting"]) == kept


def test_reorder_timer_and_session_change():
    kernel = Reorder(ReorderConfig())
    got = [r["event_ts_ms"] for t in (100_000, 130_000) for r in kernel.on_chunk(t, str(t), "s", 0)]
    got += [r["event_ts_ms"] for r in kernel.on_time(15_000)]
    assert got == [100_000, 130_000]
    assert [r["kind"] for r in kernel.on_chunk(115_000, "x", "s", 20_000)] == ["late"]
    kernel.on_chunk(200_000, "y", "s", 0)
    assert [r["kind"] for r in kernel.on_chunk(5, "z", "t", 0)] == ["discarded", "ordered"]


S = StitchConfig(gap_ms=3000, stale_ms=45_000, max_ms=60_000, pre_roll_ms=500, post_roll_ms=500)


def test_stitch_gap_at_threshold():
    k = Stitch(S)
    assert list(k.on_chunk("a", 0, 15_000, [(1000, 12_000)])) == []
    assert k.s["start_off"] == 500
    (flush,) = k.on_chunk("b", 15_000, 15_000, [(0, 4000)])
    assert flush["reason"] == "gap" and not flush["missing_post_context"]


def test_stitch_silence():
    k = Stitch(S)
    assert list(k.on_chunk("0", 0, 15_000, [])) == [] and k.s["stale_at"] is None
    k = Stitch(S)
    assert list(k.on_chunk("a", 0, 15_000, [(10_000, 15_000)])) == []
    assert list(k.on_chunk("b", 15_000, 15_000, [])) == []
    (flush,) = k.on_chunk("c", 30_000, 15_000, [])
    assert flush["reason"] == "gap in silence"


def test_stitch_longest_and_late():
    k = Stitch(StitchConfig(gap_ms=3000, max_ms=10_000, pre_roll_ms=500, post_roll_ms=500))
    list(k.on_chunk("a", 0, 15_000, [(0, 15_000)]))
    (flush,) = k.on_chunk("b", 15_000, 15_000, [(0, 15_000)])
    assert flush["missing_post_context"] and k.s["prior"]
    k = Stitch(S)
    k.s["expected"] = 30_000
    (late,) = k.on_chunk("x", 15_000, 15_000, [(0, 5000)])
    assert late["missing_prior_context"] and not late["missing_post_context"] and k.s["tx_start"] is None


def test_stitch_stream_of_five():
    k = Stitch(StitchConfig(gap_ms=3000, stale_ms=60_000, max_ms=600_000, pre_roll_ms=0, post_roll_ms=0))
    chunks = [
        ("100", 100_000, 15_000, [(12_500, 15_000)]),
        ("115", 115_000, 15_000, [(0, 2500), (5000, 7000)]),
        ("130", 130_000, 20_000, [(0, 2500)]),
        ("150", 150_000, 10_000, []),
        ("160", 160_000, 30_000, [(0, 2000)]),
        ("190", 190_000, 20_000, [(0, 2000)]),
    ]
    out = [r for c in chunks for r in k.on_chunk(*c)]
    assert [r["contributing_audio_uris"] for r in out] == [["100", "115"], ["130"], ["160"]]
    assert [r["missing_prior_context"] for r in out] == [False, False, True]
    (last,) = k.on_time(None)
    assert last["contributing_audio_uris"] == ["190"] and last["reason"] == "stale"


def test_ttl_is_not_prolonged():
    k = TtlFirst(10)
    assert [k.on_row(t) for t in (0, 5, 9, 10, 19, 20)] == [True, False, False, True, False, True]


def test_settings():
    with pytest.raises(ValueError):
        StitchConfig(gap_ms=10, max_ms=10)
    with pytest.raises(ValueError):
        check_timeouts(ReorderConfig(timeout_ms=50_000), StitchConfig())
    for bad in ({"fft": 300}, {"low_hz": 4000.0}, {"flat_low": 0.5}, {"hop": 0}, {"hangover_frames": -1}):
        with pytest.raises(ValueError):
            GateConfig(**bad)


def test_signal():
    assert signal.rms(np.zeros(4000)).max() == 0
    assert np.allclose(signal.rms(np.ones(4000)), 1)
    assert len(signal.rms(np.zeros(0))) == 0
    assert np.allclose(signal.flatness(np.zeros(4096), 16_000), 1, atol=1e-5)
    noise = np.random.default_rng(42).normal(0, 0.5, 16_000)
    assert 0.4 < signal.flatness(noise, 16_000).mean() <= 1
    tone = 0.9 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert signal.flatness(tone, 16_000).mean() < 0.2
    assert signal.runs(np.array([0, 1, 1, 0, 1], bool)) == [(1, 3), (4, 5)]
    assert signal.gate(np.zeros(100, np.int16)) == []
    assert signal.speech_ms(np.r_[np.full(20, 0.9), np.full(10, 0.1)], 256, 16_000) >= 250


def test_alignment():
    assert align("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert align([], ["a"]) == (0, 0, 0, 1) and align(["a"], []) == (0, 0, 1, 0)


def test_uuid5(spark):
    from pyspark.sql import functions as F

    from skerry.functions.columns import uuid5

    names = ["feed_1_2", "é", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_OID, r.n)) for r in rows)


def test_scope_and_empty_rules(spark):
    from skerry.operators.tables import BUILT_IN, Rule, evaluate

    texts = spark.createDataFrame(
        [("1", "Help! Fire! Run!"), ("2", "Look at that beautiful firefly."), ("3", "  "), ("4", None)], "feed string, text string"
    )
    rules = [BUILT_IN, Rule("own", "keyword", ("help",), level="FEED_SPECIFIC", target_feeds=("9",)), Rule("g", "group")]
    found = {r.feed: r.decisions for r in evaluate(texts, rules, feed="feed").collect()}
    assert found == {"1": ["basic_fire_terms"], "2": [], "3": [], "4": []}
    assert {r.feed: r.decisions for r in evaluate(texts, rules).collect()}["1"] == ["basic_fire_terms", "own"]


def test_manifest(spark, tmp_path):
    from skerry.sources.files import manifest

    Path(tmp_path, "m.json").write_text('[{"text": "a\nb", "offset": 1.5},\n {"text": "c", "offset": 2}]')
    Path(tmp_path, "n.jsonl").write_text('{"text": "d", "offset": 3}\n{broken}\n{"text": "e", "offset": 4}\n')
    rows = manifest(spark, str(tmp_path), "text string, offset double").collect()
    assert sorted(r.text for r in rows) == ["a b", "c", "d", "e"]


def test_dedup_stream(spark, tmp_path):
    from skerry.streaming.processors import dedup_stream

    schema = "id string, ts_ms long"
    rows = [("a", 0), ("a", 5), ("b", 1), ("a", 12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = (
        dedup_stream(stream, "id", 10)
        .writeStream.format("memory")
        .queryName("alerts")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("alerts").collect())) == [("a", 0), ("a", 12), ("b", 1)]


def test_digits_are_spelled(spark):
    from pyspark.sql import functions as F

    from skerry.functions.columns import digits_to_words

    said = {
        "unit 007 at 0": "unit seven at zero",
        "123 main": "one hundred twenty three main",
        "1000001": "one million one",
        "x90y115": "xninetyyone hundred fifteen",
        "": "",
        "1" * 22: " ".join(["one"] * 22),
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", digits_to_words(F.col("t")).alias("w"))
    assert {r.t: r.w for r in rows.collect()} == said


def test_envelopes_and_listings(spark, tmp_path):
    from pyspark.sql import functions as F

    from skerry.functions.columns import cloud_event_payload
    from skerry.sources.files import folder_listing

    bodies = ['{"data": {"message": {"data": "aGk="}}}', '{"data": {"message": {}}}', "{}", "no json", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(cloud_event_payload(F.col("b")).alias("p"))
    assert [r.p for r in rows.collect()] == ["hi", None, None, None, None]
    (tmp_path / "a.json").write_text(
        '[{"filename": "x", "filetype": "dir", "filesize": "0"}, {"filename": "y", "filetype": "file", "filesize": "12"},'
        ' {"filename": "z", "filetype": "link", "filesize": "1"}]'
    )
    found = folder_listing(spark, str(tmp_path)).orderBy("name").collect()
    assert [tuple(r) for r in found] == [("x", True, None), ("y", False, 12)]


def test_blank_texts_have_no_decisions(spark):
    texts = spark.createDataFrame([(1, "\n\t"), (2, "\u3000\xa0"), (3, "\x1c"), (4, None), (5, " x ")], "id int, text string")
    found = tables.evaluate(texts, [tables.Rule("all", "keyword", (), "ALL")])
    assert {r.id: r.decisions for r in found.collect()} == {1: [], 2: [], 3: [], 4: [], 5: ["all"]}
    again = tables.evaluate(found.withColumn("size", F.lit("clash")), [tables.Rule("x", "keyword", ("X",))])
    assert again.columns == ["id", "text", "size", "decisions"] and tables.flagged(again).count() == 1


def test_a_filter_does_not_evaluate_rules_again(spark):
    texts = spark.createDataFrame([("a fire",)], "text string")
    plan = tables.flagged(tables.evaluate(texts, [tables.BUILT_IN]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("evacuation") == 1


@pytest.mark.parametrize(
    ("text", "normal"),
    [
        ("<a]b> ok x < 3] y", "ok x 3 y"),
        ("<unknown>Engine [noise]5", "engine 5"),
        ("<> [] a", "a"),
        ("x [a>b] y <c]d", "x y cd"),
    ],
)
def test_annotations(spark, text, normal):
    assert spark.createDataFrame([(text,)], "t string").select(columns.normalise(F.col("t"))).first()[0] == normal


def test_tolerance_join_with_nulls_and_repeats(spark):
    left = spark.createDataFrame(
        [("k", 1.0, None), ("k", 1.0, "x"), ("k", 1.0, "x"), (None, 1.0, "n"), ("k", None, "v"), ("k", 90.0, "far"), ("k", -1.0, "neg")],
        "key string, a double, note string",
    )
    right = spark.createDataFrame([("k", 3.0, 2), ("k", 1.5, 1), ("k", -4.5, 0), (None, 1.0, 0)], "key string, b double, line int")
    rows = tables.tolerance_first(left, right, "key", "a", "b", 5.0, "line").collect()
    got = sorted((str(r.note), str(r.a), r.found and r.found.line) for r in rows)
    assert got == sorted(
        [("None", "1.0", 1), ("x", "1.0", 1), ("x", "1.0", 1), ("n", "1.0", None), ("v", "None", None), ("far", "90.0", None), ("neg", "-1.0", 0)]
    )


def test_numbering_of_null_tied_and_sparse_keys(spark):
    keys = [None, None, 1, 5, *([2**60] * 3000), *[i * 10**12 - 7 for i in range(500)], -(2**62)]
    rows = [(k, f"{i % 1500}", i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, v string, number int")
    got = streams.numbered(df, "k").collect()
    assert sorted(r.number for r in got) == list(range(len(keys)))
    ordered = [r.k for r in sorted(got, key=lambda r: r.number)]
    assert ordered == sorted(keys, key=lambda k: (k is not None, k or 0))
    # ties by what the rows say, so two numberings agree
    assert {(r.number, r.k, r.v) for r in got} == {(r.number, r.k, r.v) for r in streams.numbered(df.repartition(7), "k").collect()}
    small = spark.createDataFrame([(None,), (1,), (5,)], "k long")
    assert [r.number for r in streams.numbered(small, "k").orderBy("k").collect()] == [0, 1, 2]
    assert streams.numbered(small.where("false"), "k").count() == 0


def test_merge_by_place(spark):
    a = spark.createDataFrame([(10**15, 1.5, "a"), (3, 2.0, "b"), (None, 0.5, "c")], "k long, offset double, pred_a string")
    b = spark.createDataFrame([(None, 0.5, "z"), (3, 2.0, "y"), (10**15, 1.5, "x")], "k long, offset double, pred_b string")
    rows = streams.merged_by_place(a, b, "k", ("offset",)).collect()
    assert {(r.k, r.pred_a, r.pred_b) for r in rows} == {(10**15, "a", "x"), (3, "b", "y"), (None, "c", "z")}
    for wrong in (b.where("k = 3"), b.withColumn("offset", F.col("offset") + 1)):
        with pytest.raises(Exception, match="differ"):
            streams.merged_by_place(a, wrong, "k", ("offset",)).collect()


def test_kernels_keep_large_and_null_numbers(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(1, 5, big), (1, 6, None), (None, 7, big + 2)], "k long, ts long, id long")
    rows = streams.ttl_first(df, ["k"], "ts", 1, "id").collect()
    assert {(r.k, r.ts, r.id) for r in rows} == {(1, 5, big), (1, 6, None), (None, 7, big + 2)}


def test_runs_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, True, 0), (1, 2, None, 0), (1, 3, True, 0), (1, 3, True, 1)], "k int, ts long, on boolean, _run int")
    rows = streams.run_intervals(df, "k", "ts", "on", ("_run",)).collect()
    assert {(r.start_ms, r.end_ms, r.n_rows) for r in rows} == {(1, 1, 1), (3, 3, 2)}
    assert "_new" in streams.gap_sessions(df.withColumnRenamed("_run", "_new"), "k", "ts", 2).columns


def test_rule_tables(spark):
    stored = [
        ("a", True, '{"level": "GLOBAL"}', '{"evaluation_type": "KEYWORD_MATCH", "keywords": ["test"], "operator": "ALL"}'),
        ("b", None, '{"level": "FEED_SPECIFIC", "target_feeds": ["f"]}', '{"evaluation_type": "REGEX_MATCH", "expression": "x+"}'),
        ("c", False, '{"level": "GLOBAL"}', '{"evaluation_type": "RULE_GROUP", "operator": "ANY", "child_rule_ids": ["a", "b"]}'),
        ("d", True, '{"level": "GLOBAL"}', '{"evaluation_type": "REGEX_MATCH"}'),
        ("e", True, '{"level": "EVERYWHERE"}', '{"evaluation_type": "KEYWORD_MATCH", "keywords": []}'),
        ("f", True, "no json", None),
    ]
    df = spark.createDataFrame(stored, "rule_id string, is_active boolean, scope string, conditions string")
    parsed = rules.parse(df)
    errors = {r.rule_id: r.error for r in parsed.collect()}
    assert errors == {"a": None, "b": None, "c": None, "d": "bad conditions", "e": "bad scope", "f": "bad scope"}
    a, b, c = rules.load(parsed)
    assert a == tables.Rule("a", "keyword", ("test",), "ALL") and c.children == ("a", "b") and not c.is_active
    assert b.is_active and b.flags == "i" and b.level == "FEED_SPECIFIC" and b.target_feeds == ("f",)
    assert [r.rule_id for r in rules.listed(df, active=True).collect()] == ["a", "d", "e", "f"]
    assert rules.get(df, "c").count() == 1 and rules.get(df, "zz").count() == 0
    assert rules.delete(df, df.where("rule_id = 'a'").select("rule_id")).count() == 5
    assert rules.create(df, df.withColumn("is_active", F.lit(False))).where("is_active").count() == 4


def test_two_sensors():
    rate, t = 16_000, np.arange(32_000) / 16_000
    noise = np.random.default_rng(1).normal(0, 30, 32_000)
    speech = noise + np.where((t > 0.5) & (t < 1.5), 9000 * np.sin(2 * np.pi * 900 * t) * (1 + np.sin(2 * np.pi * 7 * t)), 0)
    sure, unsure = np.full(125, 0.9), np.full(125, 0.1)
    loose = GateConfig(flat_low=0.0, flat_high=1.0)
    assert signal.voice(speech, rate, sure, 256, loose) and not signal.voice(speech, rate, unsure, 256, loose)
    assert not signal.voice(np.zeros(32_000), rate, sure, 256, loose)
    assert signal.duration_ms(32_000, rate) == 2000
    assert len(signal.cut_ms(speech, rate, 500, 1500)) == 16_000 and len(signal.cut_ms(speech, rate, 1900, 9000)) == 1600
