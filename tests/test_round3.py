import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import functions as F

from skerry.catalogue import QUERIES
from skerry.llm import pages, toxicity
from skerry.operators import keywords, streams


def _matchers(names):
    for name in names:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as f:
            yield from pq.read_table(f, columns=["ids"]).column(0).to_pylist()


def test_windows_find_keywords_across_their_bounds(monkeypatch):
    monkeypatch.setattr(keywords, "WINDOWS", 7)
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab日", k=rng.choice([1, 3, 8, 9, 20]))) for _ in range(60)})
    texts = ["", *("".join(rng.choices("ab日", k=200)) + rng.choice(words) for _ in range(20)), words[-1]]
    text, word = keywords.Keywords([w.encode() for w in words]).found(pa.array(texts))
    want = {(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t}
    assert set(zip(text.tolist(), word.tolist(), strict=True)) == want and len(text) == len(want)


def test_many_rules_are_one_part(spark):
    """6,000 rules with 360,000 bytes of keywords were two automata, each of which scanned all texts."""
    rules = spark.range(6000).select(
        F.format_string("r%05d", "id").alias("rule_id"),
        F.array(F.concat(F.lpad(F.col("id").cast("string"), 60, "x"))).alias("keywords"),
        F.lit("ANY").alias("operator"),
        F.lit(True).alias("case_sensitive"),
    )
    assert [len(ids) for ids in _matchers(keywords.compiled(rules))] == [6000]
    docs = spark.createDataFrame([(1, "-" + "x" * 58 + "17-"), (2, "x" * 59 + "7 " + "x" * 56 + "5999")], "id long, text string")
    got = {r.id: r.decisions for r in keywords.keyword_decisions(docs, rules).collect()}
    assert got == {1: ["r00017"], 2: ["r00007", "r05999"]}


def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch):
    """Texts beyond a bound were not learned from, so this fit had no toxic ones; parts are averaged alike however they lie."""
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 300)
    monkeypatch.setattr(toxicity, "PART_BYTES", 20_000)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(50)}" for _ in range(120 if i % 3 == 0 else 20)]
        if i % 3 == 0:
            own[rng.randrange(120)] = rng.choice(["vileone", "horrid"])
        rows.append((i, " ".join(own), "en"))
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*((i, int(i % 3 == 0)) for i in range(240)), (900, 1), (901, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit_all(docs, labels)
    assert toxicity.fit(docs, labels) is None
    got = {r.doc_id: r._score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= toxicity.CUT) == (i % 3 == 0) for i in range(240, 300)]) > 0.9
    again = toxicity.fit_all(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.embedding, again.embedding) and model.shift == again.shift and model.cuts == again.cuts
    assert toxicity.fit_all(docs, labels.where("toxic = 0")) is None


def test_wide_nodes_are_matched_whole():
    """Lists of more than 1,500 children were matched strip by strip: 600 of these 1,600 pairs."""
    matcher = pages.Matcher()
    x, y = (" ".join(["0html", *(f"1{t}" for t, n in own for _ in range(n))]) for own in ((("p", 1000), ("li", 1600)), (("li", 1600), ("td", 1000))))
    to = matcher.align(x, y)
    assert matcher.score(matcher.tree(x), matcher.tree(y)) == 1601
    assert to == [0, *[-1] * 1000, *range(1, 1601)]


def test_sorts_of_a_key_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(streams, "TASK_ROWS", 100)
    assert streams.tasks_for(spark.range(1000)) == 10 and streams.tasks_for(spark.range(5)) == 4
    found = QUERIES["segment_ordinal"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() > 4
