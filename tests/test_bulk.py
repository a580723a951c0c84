import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.config import LeaseConfig
from skerry.functions.kernels import GapMax, TtlFirst
from skerry.operators import keywords, orbits, streams, tables


def _rows(rng, shape):
    if shape == "dense":  # one key, no gap, more than one start in a span
        return [(1, 1000 + i // 2) for i in range(400)] + [(2, 7)]
    if shape == "long":  # sessions over many blocks
        return [(1, i * 3) for i in range(300)] + [(None, i) for i in range(20)]
    keys = [None, 1, 1, 1, 1, 1, 2, 3]
    return [(rng.choice(keys), rng.randrange(-300, 3000)) for _ in range(500)]


@pytest.mark.parametrize("alone", [10, 1 << 20])
@pytest.mark.parametrize("shape", ["random", "dense", "long"])
def test_sessions_equal_the_kernels(spark, monkeypatch, shape, alone):
    monkeypatch.setattr(orbits, "ALONE", alone)
    monkeypatch.setattr(orbits, "BLOCK", 7)
    monkeypatch.setattr(orbits, "FAN", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rng = random.Random(shape)
        rows = [(k, t, i) for i, (k, t) in enumerate(_rows(rng, shape))]
        df = spark.createDataFrame([*rows, (1, None, -1)], "user long, t long, id long")
        for gap, span in ((40, 100), (10**9, 60)) if alone > 10 or shape != "long" else ((5, 1_000_000), (10**9, 60)):
            want = {}
            for key in {k for k, _, _ in rows}:
                kernel = GapMax(gap, span)
                for t in sorted(t for k, t, _ in rows if k == key):
                    session, start = kernel.on_row(t)
                    first, _, n = want.get((key, session), (start, t, 0))
                    want[key, session] = (first, t, n + 1)
            got = streams.gap_max_sessions(df, "user", "t", gap, span).collect()
            assert {(r.user, r.session): (r.start_ms, r.end_ms, r.n_rows) for r in got} == want
            assert len(got) == len(want)
        for ttl in (60, 10**9) if alone == 10 else (1,):
            kept = []
            for key in {k for k, _, _ in rows}:
                kernel = TtlFirst(ttl)
                kept += [(key, t, i) for t, i in sorted((t, i) for k, t, i in rows if k == key) if kernel.on_row(t)]
            got = [tuple(r) for r in streams.ttl_first(df, ["user"], "t", ttl, "id").collect()]
            assert sorted(got, key=str) == sorted(kept, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sessions_of_nothing(spark):
    empty = spark.createDataFrame([], "user long, t long")
    assert streams.gap_max_sessions(empty, "user", "t", 5, 9).count() == 0
    assert streams.ttl_first(empty, ["user"], "t", 5).count() == 0


def test_one_key_is_followed_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(orbits, "ALONE", 100)
    df = spark.range(3000).select(F.lit(1).cast("long").alias("user"), F.col("id").alias("t"))
    parts = orbits.sessions(df, ["user"], "t", 10, 10**9)
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert parts.where("_begins").count() == 300


def test_transition_maps_compose():
    rng = random.Random(1)
    for _ in range(200):
        t = np.cumsum([rng.choice([0, 1, 2, 5, 30]) for _ in range(rng.randrange(2, 40))])
        span, gap, cut = rng.choice([3, 12, 1000]), rng.choice([4, 25, 10**9]), rng.randrange(1, len(t))
        before = -rng.randrange(1, 5)
        whole = orbits.Map.of(t, before, span, gap)
        both = orbits.Map.of(t[:cut], before, span, gap).then(orbits.Map.of(t[cut:], int(t[cut - 1]), span, gap), span)
        for x in range(before - span + 1, before + 1):
            kernel, last, starts = (x, before, 0), before, 0
            open_ = x
            for now in t.tolist():
                if now - last >= gap or now - open_ >= span:
                    open_, starts = now, starts + 1
                last = now
            assert kernel and all([int(v[0]) for v in m.apply(np.array([x]), span)] == [open_, starts] for m in (whole, both))
            assert [int(v[0]) for v in orbits.Map.from_bytes(both.to_bytes()).apply(np.array([x]), span)] == [open_, starts]


def test_automaton_finds_what_contains_finds():
    rng = random.Random(2)
    letters = ["a", "b", "ab", "é", "日"]
    for _ in range(30):
        words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40))})
        texts = ["", *("".join(rng.choices(letters + ["x"], k=rng.choice([3, 50, 2000]))) for _ in range(20))]
        text, word = keywords.Automaton([w.encode() for w in words]).found(pa.array(texts))
        assert set(zip(text.tolist(), word.tolist(), strict=True)) == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t}


@pytest.mark.parametrize("part_bytes", [40, 1 << 18])
def test_rules_in_bulk_equal_rules_one_by_one(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(keywords, "PART_BYTES", part_bytes)
    monkeypatch.setattr(keywords, "HELD_BYTES", 20_000)
    rng = random.Random(4)
    rules = []
    for i in range(60):
        words = tuple("".join(rng.choices("abÉé ", k=rng.randrange(0, 4))) for _ in range(rng.randrange(4)))
        own = rng.random() < 0.2
        rules.append(
            tables.Rule(
                f"r{i}", "keyword", words, rng.choice(["ANY", "ALL"]), rng.random() < 0.5, is_active=rng.random() < 0.8,
                level="FEED_SPECIFIC" if own else "GLOBAL", target_feeds=("x",) if own else (),
            )
        )
    texts = [None, "", " \n\t", "a" * 5000 + "b", *("".join(rng.choices("abAB Éé", k=rng.randrange(1, 40))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, rng.choice(["x", "y", None]), 1) for i, t in enumerate(texts)], "id long, text string, feed string, decisions int")
    stored = spark.createDataFrame(
        [(r.rule_id, list(r.keywords), r.operator, r.case_sensitive, r.is_active, r.level, list(r.target_feeds)) for r in rules],
        "rule_id string, keywords array<string>, operator string, case_sensitive boolean, is_active boolean, level string, target_feeds array<string>",
    )
    got = {r.id: r.decisions for r in keywords.keyword_decisions(docs, stored, feed="feed").collect()}
    want = {r.id: sorted(r.decisions) for r in tables.evaluate(docs, rules, feed="feed").collect()}
    assert got == want
    plan = keywords.keyword_decisions(docs, stored)._jdf.queryExecution().toString()
    assert "contains" not in plan.lower()
    assert all(r.decisions == [] for r in keywords.keyword_decisions(docs, stored.limit(0)).collect())
    assert keywords.keyword_decisions(docs.limit(0), stored).count() == 0


def test_rules_with_nulls(spark):
    stored = spark.createDataFrame(
        [("n", None, None, None), ("all", None, "ALL", None), ("null word", ["b", None], "ALL", False), ("n", ["a"], None, None), (None, ["a"], "ANY", True)],
        "rule_id string, keywords array<string>, operator string, case_sensitive boolean",
    )
    docs = spark.createDataFrame([(1, "AB"), (2, "b")], "id long, text string")
    got = {r.id: r.decisions for r in keywords.keyword_decisions(docs, stored.where("rule_id IS NOT NULL")).collect()}
    assert got == {1: ["all", "n", "null word"], 2: ["all", "null word"]}


NOW = datetime.datetime(2024, 6, 1)


def test_allocation(spark):
    old = NOW - datetime.timedelta(hours=1)
    rows = [(i, f"f{i}", "unclaimed", None, None, None, 0, 3) for i in range(7)]
    rows += [(10 + i, "x", "active", "w", old, None, 0, 1) for i in range(3)]  # ties
    rows += [(20, "y", "active", "w", None, None, 0, 1), (21, "y", "active", "w", NOW, None, 0, 1)]  # no heartbeat, a fresh one
    rows += [(30, "z", "failing", None, old, None, 2, 1), (31, "z", "failing", None, old, NOW + datetime.timedelta(hours=1), 2, 1)]
    feeds = spark.createDataFrame(
        rows, "id long, name string, status string, worker_id string, last_heartbeat timestamp, retry_after timestamp, failure_count int, fencing_token int"
    )
    urls = spark.createDataFrame([(1, "http://1")], "id long, stream_url string")
    now, c = F.lit(NOW).cast("timestamp"), LeaseConfig()

    def given(workers):
        df = spark.createDataFrame(workers, "worker_id string, capacity long, turn long")
        got = tables.allocate(feeds, df, urls, now, c)
        out = {}
        for r in got.collect():
            assert r.status == "active" and r.last_heartbeat == NOW and r.name
            out.setdefault(r.worker_id, []).append(r.id)
        return {k: sorted(v) for k, v in out.items()}

    # priority: unclaimed, then failing and due (no retry time, old heartbeat), active and stale, by id
    assert given([("b", 3, 2), ("a", 5, 1), ("none", 0, 0), ("minus", -2, 0), ("null", None, 0)]) == {"a": [0, 1, 2, 3, 4], "b": [5, 6, 10]}
    assert given([("b", 100, None), ("a", 4, 1)]) == {"b": [*range(7), 10, 11, 12, 30]}
    assert given([("b", 2, 1), ("a", 2, 1)]) == {"a": [0, 1], "b": [2, 3]}
    assert given([]) == {}
    assert tables.allocate(feeds.limit(0), spark.createDataFrame([("a", 1, 1)], "worker_id string, capacity long, turn long"), urls, now, c).count() == 0


def test_numbering_any_key(spark):
    rows = [(w, i % 3, None if i % 5 == 0 else i) for i, w in enumerate(["b", None, "a", "", "a", "a", "日"] * 40)]
    df = spark.createDataFrame(rows, "k string, v int, w long").repartition(3)
    got = streams.numbered(df, "k").orderBy("number").collect()
    assert [r.number for r in got] == list(range(len(rows)))
    assert [r.k for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, (k or "").encode()))
    assert streams.numbered(df.limit(0), "k").count() == 0
    total = streams.running_total(df, "w", "k").collect()
    placed = sorted(total, key=lambda r: r.before)
    assert sum(r.w or 0 for r in total) == max(r.before + (r.w or 0) for r in placed)
    assert all(sum(q.w or 0 for q in total if (q.k is not None, (q.k or "").encode()) < (r.k is not None, (r.k or "").encode())) <= r.before for r in total)
    same = spark.range(1000).select(F.lit(1).alias("k"))
    assert sorted(r.number for r in streams.numbered(same, "k").collect()) == list(range(1000))
