import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry.streaming import topic

SCHEMA = "k string, t long, v long"


def _rows(spark, n, shift=0):
    return spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 101).alias("t"),
        (F.col("id") + shift).alias("v"),
    )


def test_a_batch_is_there_once_and_in_order(spark, tmp_path):
    path = str(tmp_path / "topic")
    rows = _rows(spark, 400)
    assert topic.publish(rows, path, 3, "k", ("t", "v"))
    assert not topic.publish(_rows(spark, 9, 1000), path, 3, "k", ("t", "v"))  # replayed, perhaps otherwise
    got = topic.read(spark, path, SCHEMA + ", place long").collect()
    assert sorted(r.v for r in got) == list(range(400))
    held: dict = {}
    for i, name in enumerate(topic.files(path)):
        for r in pq.read_table(name).to_pylist():
            held.setdefault(r["k"], []).append((i, r))
    assert set(held) == {None, "k1", "k2", "k3"}
    for own in held.values():
        assert len({i for i, _ in own}) == 1  # one file a key
        assert [(r["t"], r["v"]) for _, r in own] == sorted((r["t"], r["v"]) for _, r in own)
        assert [r["place"] for _, r in own] == list(range(len(own)))
    assert topic.publish(rows.limit(0), path, 4)
    assert topic.read(spark, path, SCHEMA).count() == 400
    with pytest.raises(ValueError, match="name"):
        topic.publish(rows, path, "a/b")


def test_what_fails_is_not_there(spark, tmp_path):
    path = str(tmp_path / "topic")
    broken = _rows(spark, 100).withColumn("v", F.when(F.col("v") == 77, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        topic.publish(broken, path, "first")
    assert topic.read(spark, path, SCHEMA).count() == 0
    assert topic.publish(_rows(spark, 100), path, "first")
    assert topic.read(spark, path, SCHEMA).count() == 100


def test_of_two_writers_of_one_name_one_stays(spark, tmp_path):
    path, done = str(tmp_path / "topic"), []

    def write(shift):
        done.append((shift, topic.publish(_rows(spark, 50, shift), path, "one")))

    both = [threading.Thread(target=write, args=(s,)) for s in (0, 1000)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    winners = [s for s, won in done if won]
    assert len(done) == 2 and len(winners) == 1
    assert {r.v // 1000 * 1000 for r in topic.read(spark, path, SCHEMA).collect()} == set(winners)
    assert len(list((tmp_path / "topic" / "data").iterdir())) == len(topic.files(path))  # the loser's files are gone


def test_absent_rows_under_a_race(spark, tmp_path):
    path, attempts = str(tmp_path / "table"), []
    df = [spark.createDataFrame([(k, w) for k in range(w, w + 20)], "k long, w long") for w in (0, 10, 5)]
    writers = [threading.Thread(target=lambda d=d: attempts.append(topic.append_absent(d, path, ["k"]))) for d in df]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert len(attempts) == 3
    assert sorted(r.k for r in topic.read(spark, path, "k long, w long").collect()) == list(range(30))


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(2):
        _rows(spark, 40, 100 * i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    topic.register(spark)
    by_sort, by_source = str(tmp_path / "a"), str(tmp_path / "b")
    one = stream.writeStream.foreachBatch(topic.each_batch(by_sort, "k", ("t", "v"))).option("checkpointLocation", str(tmp_path / "ca")).trigger(availableNow=True).start()
    assert one.awaitTermination(90)
    two = stream.writeStream.format(topic.FORMAT).option("path", by_source).option("order", "k,t,v").option("checkpointLocation", str(tmp_path / "cb")).trigger(availableNow=True).start()
    assert two.awaitTermination(90)
    for path in (by_sort, by_source):
        assert topic._manifests(path) == [f"{i:020d}.json" for i in range(2)]
        assert sorted(r.v for r in topic.read(spark, path, SCHEMA).collect()) == [*range(40), *range(100, 140)]
    for name in topic.files(by_source):
        own = [((r["k"] or "~"), r["t"], r["v"]) for r in pq.read_table(name).to_pylist()]
        assert own == sorted(own)


def test_create_only(tmp_path):
    name = str(tmp_path / "a" / "x.json")
    assert topic.create_only(name, "1") and not topic.create_only(name, "2")
    assert (tmp_path / "a" / "x.json").read_text() == "1" and len(list((tmp_path / "a").iterdir())) == 1
