import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import merkle, queries, repair, urls

DATA = "/root/testdata/sf0.001"
VALID = re.compile(r"(s?(ua)+)?")


def _every_repair(rows):
    """(cost, audit) of all edits of a few rows (initial, fault), with at most two insertions in a row."""
    steps = []
    for initial, fault in rows:
        own = [("D", 4, "")]
        if fault < 2:
            own += [("K", 3 * fault, initial), ("R", 3 + 3 * fault, "u"), ("R", 3 + 3 * fault, "a")]
        steps.append(own)
    between = [("I" * k, 3 * k, "".join(p)) for k in range(3) for p in itertools.product("ua", repeat=k)]
    for picked in itertools.product(*steps):
        for more in itertools.product(between, repeat=len(rows) + 1):
            parts = [more[0], *itertools.chain(*zip(picked, more[1:], strict=True))]
            if VALID.fullmatch("".join(p[2] for p in parts)):
                yield sum(p[1] for p in parts), "".join(p[0] for p in parts)


def test_search_finds_the_least_of_all_repairs():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(1 if n == 0 else 40):
            rows = [(rng.choice("xsua"), rng.randrange(3)) for _ in range(n)]
            codes = bytes(3 * "xsua".index(i) + f for i, f in rows)
            assert repair.search(codes) == min(_every_repair(rows)), rows


def test_search_of_a_long_conversation_is_linear():
    rng = random.Random(6)
    codes = bytes(rng.randrange(12) for _ in range(30_000))
    cost, audit = repair.search(codes)
    assert len(audit) - audit.count("I") == len(codes)
    assert cost == repair.bounds(codes)[repair.START]
    assert repair.search(codes[:12])[0] == repair.bounds(codes[:12])[0]


def _plain_report(rows):
    """What ``report`` says of the (turn, role, text) of one conversation."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(repair.WHITE)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(kind)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    codes = bytes(3 * (" sua".find(r[1][:1]) if r[1][:1] in ("s", "u", "a") else 0) + {None: 0, "truncated": 1}.get(f, 2) for r, f in zip(rows, faults, strict=True))
    cost, audit = repair.search(codes)
    out, at = [], 0
    for edit in audit:
        last = out[-1][0][:1] if out else ""
        due = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((due, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if edit != "D":
            out.append((role if edit == "K" else due, text))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    illegal = sum((a[1][:1] + b[1][:1]) not in repair.LEGAL for a, b in zip(rows, rows[1:], strict=False))
    assert VALID.fullmatch("".join(r[:1] for r, _ in out))
    return (gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, step int, place int, fault string"
    long = "Ein Satz. " * 40_000
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."),
        (2, None, "user", "first."), (2, 5, "assistant", "last, cut"), (2, 3, None, "who."), (2, 3, "", "nobody!"),
        (3, 0, "user", None), (3, 1, "assistant", " \n\t"), (4, 7, "system", "alone."), (5, 0, "user", long),
        (None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, None, None, None),
        (6, 0, "user", "a."), (6, 0, "user", "b."), (6, 0, "user", "a."), (6, 9, "tool", "c?"),
    ]
    turns = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], schema).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.report(repair.edit_script(turns), turns).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for i in ids:
        assert got[i] == _plain_report([r[1:] for r in rows if r[0] == i]), i
    script = repair.edit_script(turns)
    assert script.where("edit = 'D' AND text IS NOT NULL").count() == 0
    empty = turns.limit(0)
    assert repair.report(repair.edit_script(empty), empty).count() == 0
    # an id of which nothing is left
    lost = repair.report(repair.edit_script(turns.where("conv_id <> 4")), turns).where("conv_id = 4").first()
    assert (lost.cost, lost.audit, lost.repaired_sha256) == (0, "", hashlib.sha256().hexdigest())


def test_one_conversation_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rng = random.Random(8)
        rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Ja.", "Nein", f"{i}!", ""])) for i in range(1500)]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = repair.report(repair.edit_script(turns), turns).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(got)[1:] == _plain_report([r[1:] for r in rows])


def test_damage(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = []
    for r in rows.collect():
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text
            want += [(r.conv_id, r.turn, "user" if h == 4 else r.role, text)] * (2 if h == 3 else 1)
    assert sorted(map(tuple, repair.damage(rows).collect())) == sorted(want)
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    h = zlib.crc32(b" : ") % 20
    assert repair.damage(nulls).count() == (0 if h == 0 else 2 if h == 3 else 1)


def _fits(glob):
    """The glob as a regular expression."""
    parts = re.findall(r"\\.|\*\*|\*|\?|.", glob, re.S)
    say = {"**": ".*", "*": "[^/?]*", "?": "[^/?]"}
    return re.compile("".join(say.get(p) or re.escape(p[-1]) for p in parts), re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    signs = ["a", "b", "/", "?", ".", "é", "\\?", "\\*", "*", "**", "ab/ab.ab" * 9]
    globs = ["", "*", "**", "?", "a*b", "**a", *("".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(300))]
    texts = ["", "a", "é", "?", "\n", *("".join(rng.choices(["a", "b", "/", "?", ".", "é", "*", "ab/ab.ab" * 9], k=rng.randrange(12))) for _ in range(400))]
    forms = [_fits(g) for g in globs]
    bits = urls.Automaton(globs)
    data, at = urls.buffers(pa.array(texts))
    ends = bits.run(data, at)
    got = np.stack([(ends[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1 for k in bits.last], axis=1)
    want = np.array([[bool(f.fullmatch(t)) for f in forms] for t in texts])
    assert (got == want).all()
    first = [next((k for k, hit in enumerate(row) if hit), -1) for row in want]
    assert bits.first_match(pa.array(texts)).tolist() == first
    assert urls.Automaton([]).first_match(pa.array(["a", None])).tolist() == [-1, -1]


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "http://a.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.example.org/es/?page=2": ("x.example.org", "/es/", "example.org/es/", "block"),
        "https://org": ("org", "", None, "allow"),
        "https://org?a/": ("org", "", None, "allow"),
        "https://a.com?x.org/": ("a.com", "", None, "allow"),
        "https://a.net/x.org/": ("a.net", "/x.org/", None, "allow"),
        "https://a.com/fr/#/de/": ("a.com", "/fr/", "com/fr/", "allow"),
        "https://a.com/de/x://y.org/": ("a.com", "/de/x://y.org/", "com/de/", "block"),
        "https://a.net/l?page=3": ("a.net", "/l", None, "block"),
        "https://a.net/l#?page=3": ("a.net", "/l", None, "allow"),
        "https://ÄB.net/": ("Äb.net", "/", None, "allow"),
        "ftp://u:p@[::1]:8/x": ("u:p@[::1]:8", "/x", None, "allow"),
        "https://a.net/" + "x" * 100_000 + "/login": ("a.net", "/" + "x" * 100_000 + "/login", None, "block"),
    }
    schema = "page_id long, url string, host string, Rule int"
    rows = [(i, u, "old", 1) for i, u in enumerate(cases)] + [(0, None, "old", 1), (None, "http://a.org/", None, None)]
    df = spark.createDataFrame(rows, schema)
    found = urls.judge(df)
    assert sorted(found.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    got = [((r.url), (r.host, r.path, r.rule, r.verdict)) for r in found.collect()]
    assert len(got) == len(rows)
    for url, said in got:
        assert said == (cases[url] if url in cases else ("a.org", "/", "org/", "allow")), url
    assert urls.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.Rule("allow", "org").globs()


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(nodes):
    """(root, per leaf its steps as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            paths[i].append(("", nodes[a + 1] if a + 1 < len(nodes) else "") if a % 2 == 0 else (nodes[a - 1], ""))
        nodes = [_sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], paths


def _plain_manifest(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of rows of ``FIELDS``."""
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    runs = {}
    for r in rows:
        hurt = r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        changed = (*r[:3], r[3] + 1, r[4]) if hurt else r
        runs.setdefault(r[2], []).append((r[0], *(_sha("".join(map(say, x))) for x in (r, changed))))
    names = sorted(runs, key=lambda n: (n is not None, (n or "").encode()))
    trees = []
    for n in names:
        runs[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(_tree([x[1] for x in runs[n]]))
    if not names:
        return []
    root, above = _tree([t[0] for t in trees])
    out = []
    for n, (sub, paths), up in zip(names, trees, above, strict=True):
        for (doc_id, own, changed), path in zip(runs[n], paths, strict=True):
            node = changed
            for left, right in path + up:
                node = _sha(left + node + right)
            out.append((doc_id, own, sub, root, _sha("".join(a + b for a, b in path + up)), node, node == root))
    return out


@pytest.mark.parametrize("levels", [2, 8])
def test_merkle(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    long = "wort " * 100_000
    rows = [(i, "s", rng.choice(["de", "de", "de", "en", "zu", None, "", "é"]), rng.choice([1, None, 20]), "Text 日本") for i in range(90)]
    rows += [(3, "s", "de", 1, "same")] * 7 + [(None, None, None, None, None), (None, None, None, None, None), (5, None, "xx", None, long)]
    rows += [(2**63 - 1, "", "lone", 2**63 - 1, "")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, slot int, run string, node string"
    for given in (rows, rows[-1:], []) if levels > 2 else (rows,):
        df = spark.createDataFrame([(*r, 1, "x", "y") for r in given], schema).repartition(5)
        df.select("doc_id", "text", "lang", "source", "n_chars", "slot", "run", "node").write.parquet(f"{tmp_path}/{len(given)}/documents.parquet")
        got = queries.op13_merkle(spark, f"{tmp_path}/{len(given)}")
        key = lambda r: [str(x) for x in r]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain_manifest(given), key=key)


def test_merkle_numbers_equal_rows_apart(spark):
    df = spark.range(4000).select(F.lit("").alias("run"), F.lit(1).alias("doc_id"), F.lit("x").alias("node"))
    got = merkle.numbered(df, ["doc_id", "node"])
    assert sorted(r.slot for r in got.collect()) == list(range(4000))
    assert got.where("n <> 4000").count() == 0
