import io
import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry.llm import chat, decontaminate, pages, pfor, queries, rules, tokens

DATA = "/root/testdata/sf0.001"


def _prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("flat", [True, False])
@pytest.mark.parametrize("blocks", [0, 1, 4, 20, 60])
def test_short_articles_under_much_boilerplate(spark, blocks, flat):
    """From no constant text to 95 percent of it, with names that say nothing, in the article's container or beside it."""
    rng = random.Random(blocks)
    fixed = [_prose(rng, 15) for _ in range(blocks)]
    rows, want = [], {}
    for i in range(30):
        own = [_prose(rng, 25), _prose(rng, 25)]
        around = "".join(f"<p>{t}</p>" for t in fixed)
        inside = "".join(f"<p>{t}</p>" for t in own)
        body = f"<div>{around}{inside}</div>" if flat else f"<div><div>{around}</div><div>{inside}</div></div>"
        rows.append((i, f"http://host.example/{i}", f"<html><body>{body}</body></html>"))
        want[i] = "\n".join(own)
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_roles_and_texts_of_control_characters(spark):
    signs = ["<", "[", "]", "] ", "\\", "<s>[", " </s>", "[/INST]", "x", "\n", ""]
    texts = ["".join(p) for p in itertools.product(signs, repeat=2)]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(texts) if t % 3 else "assistant", rng.choice(texts)) for c in range(60) for t in range(8)]
    rows += [(1000 + i, 0, role, "hello") for i, role in enumerate(["x] y", "x]", "]\\", "\\] "])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns).collect()
    for r in made:
        want = [(a.encode(), b.encode()) for c, t, a, b in sorted(rows) if c == r.conv_id]
        assert chat.read_turns(r.formatted.encode()) == want
        own = [b for a, b in want if a == b"assistant"]
        assert [chat.unescape(r.formatted.encode()[x:y]) for x, y in zip(r.loss_starts, r.loss_ends, strict=True)] == own


def test_held_index_parts_stay_within_their_bound(tmp_path, monkeypatch):
    import pickle

    files = []
    for k in range(6):
        pq.write_table(pa.table({"image": pa.array([pickle.dumps(b"x" * 1000)], pa.binary())}), f"{tmp_path}/{k}.parquet")
        files.append(f"file://{tmp_path}/{k}.parquet")
    size = len(pickle.dumps(b"x" * 1000))
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 2 * size + 10)
    monkeypatch.setattr(decontaminate, "_held", {})
    for _ in range(4):  # batches
        assert len(list(decontaminate._indexes(files))) == 6
        assert len(decontaminate._held) == 2
    assert len(list(decontaminate._indexes(files[4:]))) == 2
    assert sorted(decontaminate._held) == files[4:]


def test_any_block_and_document_of_a_file():
    rng = np.random.default_rng(1)
    for n_docs in (0, 1, 40):
        lengths = [int(x) for x in rng.choice([0, 1, 7, 1024, 2500], n_docs)]
        ids = np.where(rng.random(sum(lengths)) < 0.02, 2**32 - 1, rng.integers(0, 5000, sum(lengths))).astype(np.uint32)
        doc_ids = [None if i == 3 else i for i in range(n_docs)]
        image = pfor.write_bytes(doc_ids, lengths, ids)
        file = pfor.File(io.BytesIO(image))
        assert file.doc_ids == doc_ids and file.lengths.tolist() == lengths
        for k in range(len(file.least)):
            assert (file.blocks(k, k + 1) == ids[k * pfor.BLOCK : (k + 1) * pfor.BLOCK]).all()
        ends = np.cumsum(lengths)
        for i in range(n_docs):
            assert (file.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
    with pytest.raises(ValueError):
        pfor.File(io.BytesIO(b"x" * 100))


def test_a_document_is_read_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    manifest = pfor.write_ids(docs)
    wanted = spark.createDataFrame([(5,), (17,), (17,), (10**9,), (None,)], "doc_id long")
    got = {r.doc_id: r.ids for r in pfor.find_ids(manifest, wanted).collect()}
    encoder = tokens.ChunkEncoder()
    texts = {r.doc_id: r.text for r in docs.where("doc_id IN (5, 17)").collect()}
    assert got == {i: [*np.frombuffer(encoder.encode(t), "<u4").tolist(), 1] for i, t in texts.items()}


def test_another_tokenizer_file_is_read_as_it_is(tmp_path):
    with open(tokens.DEFAULT_FILE, encoding="utf-8") as f:
        found = json.load(f)
    found["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f)
    other = tokens.ChunkEncoder(path)
    texts = ["Some Words, in Upper Case", "", None, "x  y\n"]
    assert other.plain and not tokens.ChunkEncoder().plain
    assert other.encode_all(pa.array(texts, pa.large_string())) == [other.whole(t or "") for t in texts]


def test_ablation_reads_the_stored_ledger(spark):
    ledger = rules.stored(rules.rule_ledger(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).drop("text"))
    rows = ledger.collect()
    for policy in rules.POLICIES:
        for r in rules.ablation(ledger, policy).collect():
            bit, whole = rules.mask((r.rule,)), rules.mask(policy)
            assert r.n_rows == len(rows)
            assert r.n_failed == sum(x.fail_bits & bit != 0 for x in rows)
            assert r.n_only == sum(x.fail_bits & whole == bit for x in rows)
    again = queries.rule_ablation(spark, DATA)
    assert again.count() == sum(map(len, rules.POLICIES.values()))
    assert "text" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert rules.ablation(ledger.where(F.lit(False))).where("n_rows <> 0").count() == 0
