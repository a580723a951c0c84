from itertools import product

import pyarrow as pa

from skerry.llm import packing, queries, tokens


def test_packing_asks_the_library_once_for_a_piece(spark, monkeypatch):
    """A task that met more than 100,000 different pieces forgot what it had asked for: here it asked for all of them twice."""
    seen = {}
    monkeypatch.setattr(tokens, "SLICE", 1 << 18)
    monkeypatch.setattr(packing, "pack", lambda docs, **own: seen.update(own))
    queries.op4_best_fit(spark, "/root/testdata/sf0.001")
    names = ["".join(p) for p in product("abcdefghijklmnopqrstuvwxyz", repeat=4)][:240_000]
    asked, merge = [], tokens.ChunkEncoder._merge
    monkeypatch.setattr(tokens.ChunkEncoder, "_merge", lambda self, pieces: asked.append(len(pieces)) or merge(self, pieces))
    texts = [" ".join(names[at : at + 1000]) for at in range(0, len(names), 1000)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = []
    for size in (seen.get("remembered", tokens.REMEMBERED), tokens.REMEMBERED):
        asked.clear()
        found.append(list(packing._cut_texts(tokens.DEFAULT_FILE, packing.CAPACITY, 0, size)(iter([batch]))))
        assert sum(asked) == (len(names) if not found[1:] else 2 * len(names))
    assert found[0] == found[1]
