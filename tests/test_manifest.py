import io
import json
import random

import pytest

from skerry.sources import files

SCHEMA = "text string, offset double, deep struct<a: string>"


def _manifest(rng, n, array):
    parts, want = [], []
    for i in range(n):
        text = rng.choice([f"t{i}", f"brace }} {{ {i}", f"lines }}\n{{ {i}", f'quote \\" }}\n {{ {i}', f"end \\\\ {i}", "long " * rng.choice([1, 400]), "日本\n語"])
        kind = rng.random()
        body = '{"text": "%s", "offset": %d, "deep": {"a": "}"}}' % (text, i)
        if kind < 0.1:
            body = body.replace('"offset"', "broken", 1)
        elif kind < 0.2:
            body = body.replace(", ", ",\n  ")
        if kind >= 0.1:
            want.append((json.loads(body, strict=False)["text"].replace("\n", " "), float(i)))
        parts.append(body)
    glue = rng.choice([",\n", "\n", " ,\n\n  ", ",\r\n"]) if array else rng.choice(["\n", "\r\n", "\n\n "])
    return ("[\n" + glue.join(parts) + "\n]\n" if array else glue.join(parts) + rng.choice(["", "\n"])), want


def test_every_cut_gives_the_same_objects(monkeypatch):
    monkeypatch.setattr(files, "READ_BYTES", 50)
    monkeypatch.setattr(files, "AROUND", 100)
    rng = random.Random(7)
    for _ in range(30):
        text, _ = _manifest(rng, rng.randrange(1, 30), rng.random() < 0.5)
        data = text.encode()
        whole = list(files.objects(io.BytesIO(data), 0, len(data)))
        for size in (1, 7, 64, 333):
            cut = [o for a in range(0, len(data), size) for o in files.objects(io.BytesIO(data), a, a + size)]
            assert cut == whole


@pytest.mark.parametrize("size", [100, 1 << 25])
def test_manifests_in_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(files, "RANGE_BYTES", size)
    rng, want = random.Random(3), []
    for k in range(4):
        text, own = _manifest(rng, 40, k % 2 == 0)
        (tmp_path / f"m{k}.json").write_text(text)
        want += own
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n[]\n")
    got = files.manifest(spark, str(tmp_path), SCHEMA)
    assert sorted((r.text, r.offset) for r in got.collect()) == sorted(want)
    assert got.where("deep.a <> '}'").count() == 0
