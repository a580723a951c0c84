"""Benchmark decontamination: test items in a BM25 index, every passage of every text as a query.

Impacts are divided by the item's score for its own text, so one threshold fits all items.  Retrieval is
block-max WAND in array form: a passage whose terms' highest impacts cannot reach the threshold is passed
over; then only the blocks of items whose highest impacts can reach it are opened; then items are scored.
A hit counts if it holds enough of both the item's question and its answer.

The index is built by tasks, in parts of a bounded size in the shared folder, with term statistics of the whole
benchmark; a task holds some of the parts, and reads the rest again for each batch of documents.  Passages are
as long as an item's own length asks for, so a link does not depend on what other items there are, but for
those statistics.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.storage import cut, lean, scratch, uri

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 3
ITEMS_PER_BLOCK = 16
#: Passages that are scored together.
PASSAGES = 256
#: Passages of items of so many words begin so many words apart; longer items double it.
LEAST_STRIDE = 64
#: Bytes of item texts in a part of the index, about, and of index parts that a worker holds.
PART_BYTES, HELD_BYTES = 4 << 20, 256 << 20


def _grams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(words.shingles(hashes, np.array([0, len(hashes)]), GRAM)[0])


def _short_grams(hashes: np.ndarray) -> np.ndarray:
    """What ``_grams`` makes of every run of one or two words, as if it were an item."""
    found = []
    for n in range(1, GRAM):
        runs = np.lib.stride_tricks.sliding_window_view(hashes, n) if len(hashes) >= n else hashes[:0].reshape(0, n)
        found.append(words.shingles(runs.ravel(), np.arange(len(runs) + 1) * n, GRAM)[0])
    return np.concatenate(found)


def answer_words(text: str) -> int:
    """Words of the item's answer: its last sentence, or the last third of a single one; ``GRAM`` at least."""
    parts = [p for p in text.replace("?", "?\n").replace(".", ".\n").split("\n") if p.strip()]
    sizes = [len(hash_terms(pa.array([p], pa.large_string()))[0]) for p in parts]
    sizes = [n for n in sizes if n]
    return max(GRAM, sizes[-1] if len(sizes) > 1 else sum(sizes) // 3)


class Index:
    """Postings by term, with the highest impact of each block of items and of each term."""

    def __init__(self, items: list[tuple[int | None, str]], terms: np.ndarray, idf: np.ndarray, mean: float, stride: int):
        """``terms`` (sorted) and ``idf``: of all terms of the items, over the whole benchmark; ``mean``: words of
        its items; ``stride``: words of the longest item at least.
        """
        hashes, first = hash_terms(pa.array([t for _, t in items], pa.large_string()))
        self.ids, self.stride = [i for i, _ in items], stride
        owner = np.repeat(np.arange(len(items)), np.diff(first))
        order = np.lexsort((owner, hashes))
        term, own = hashes[order], owner[order]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])])
        tf = np.diff(np.r_[new, len(term)])
        term, own = term[new], own[new]
        self.terms, start, df = np.unique(term, return_index=True, return_counts=True)
        self.start = np.r_[start, len(term)]
        norm = K1 * (1 - B + B * np.diff(first) / mean)
        weight = idf[np.searchsorted(terms, self.terms)]
        impact = np.repeat(weight, df) * tf * (K1 + 1) / (tf + norm[own])
        itself = np.bincount(own, weights=impact, minlength=len(items))
        self.item, self.impact = own, impact / itself[own]
        self.top = np.maximum.reduceat(self.impact, start)
        block = own // ITEMS_PER_BLOCK
        at = np.repeat(np.arange(len(self.terms)), df)
        edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])])
        self.block, self.block_top = block[edge], np.maximum.reduceat(self.impact, edge)
        self.block_start = np.searchsorted(edge, self.start)
        self.n_blocks = int(block.max()) + 1
        self.question, self.answer = [], []
        self.short = bool((np.diff(first) < GRAM).any())
        for k, (_, text) in enumerate(items):
            own, n = hashes[first[k] : first[k + 1]], answer_words(text)
            one = len(own) < n + GRAM  # then question and answer are one
            self.question.append(_grams(own if one else own[:-n]))
            self.answer.append(_grams(own if one else own[-n:]))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each word, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
            out[near] = np.where(self.terms[at] == hashes[near], at, -1)
        return out

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word) of every passage and item that reach the threshold."""
        n = np.diff(first)
        if not n.sum():
            return []
        s = self.stride
        per_text = np.maximum(1, -(-n // s) - 1)
        text = np.repeat(np.arange(len(n)), per_text)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = first[text] + turn * s
        end = np.minimum(begin + 2 * s, first[text + 1])
        term = self.known(hashes)
        most = np.concatenate(([0.0], np.cumsum(np.where(term >= 0, self.top[term], 0.0))))
        live = np.flatnonzero(most[end] - most[begin] >= THRESHOLD - 1e-9)
        if not len(live):
            return []
        out = []
        for k in range(0, len(live), PASSAGES):  # a bounded piece of work at a time
            part = live[k : k + PASSAGES]
            for p, item, x in self._score(term, begin[part], end[part]):
                out.append((int(text[part[p]]), item, x, int(begin[part[p]]), int(end[part[p]])))
        return out

    def _score(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of the passages that passed the first bound."""
        size = end - begin
        passage = np.repeat(np.arange(len(size)), size)
        own = term[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        pair = np.unique(passage[own >= 0] * len(self.terms) + own[own >= 0])
        passage, own = np.divmod(pair, len(self.terms))
        spread = self.block_start[own + 1] - self.block_start[own]
        at = np.repeat(self.block_start[own] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
        cell, back = np.unique(np.repeat(passage, spread) * self.n_blocks + self.block[at], return_inverse=True)
        cell = cell[np.bincount(back, weights=self.block_top[at], minlength=len(cell)) >= THRESHOLD - 1e-9]
        some = np.isin(passage, cell // max(1, self.n_blocks))
        passage, own = passage[some], own[some]
        spread = self.start[own + 1] - self.start[own]
        at = np.repeat(self.start[own] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
        owner = np.repeat(passage, spread)
        opened = np.isin(owner * self.n_blocks + self.item[at] // ITEMS_PER_BLOCK, cell)
        at, owner = at[opened], owner[opened]
        found, back = np.unique(owner * len(self.ids) + self.item[at], return_inverse=True)
        score = np.bincount(back, weights=self.impact[at], minlength=len(found))
        for f, x in zip(found[score >= THRESHOLD].tolist(), score[score >= THRESHOLD].tolist(), strict=True):
            yield (*divmod(f, len(self.ids)), x)

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int | None, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap) of every passage that holds an item."""
        for a, b in words.slices(texts):
            hashes, first = hash_terms(texts.slice(a, b - a))
            for text, item, score, begin, end in self.search(hashes, first):
                grams = _grams(hashes[begin:end])
                if self.short:
                    grams = np.concatenate((grams, _short_grams(hashes[begin:end])))
                q, w = (float(np.isin(x, grams).mean()) for x in (self.question[item], self.answer[item]))
                if q >= OVERLAP and w >= OVERLAP:
                    yield text + a, self.ids[item], round(score, 6), q, w


def hash_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = words.buffers(texts)
    hashes, first = words.hash_words(words.lower(data), bounds, words.LETTERS)
    return hashes[0], first


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with the stride of their passages, their number of words and their different terms."""
    for batch in batches:
        hashes, first = hash_terms(batch.column(1))
        own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        n = np.diff(first).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([max(LEAST_STRIDE, 1 << (k - 1).bit_length()) if k else 0 for k in n], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array(own, pa.list_(pa.int64())),
            ],
            names=["item_id", "text", "stride", "n_words", "terms"],
        )


def _build(mean: float):
    def run(key: tuple, items: pa.Table, weights: pa.Table) -> pa.Table:
        stride, part = (k.as_py() for k in key)
        rows = zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True)
        known = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        terms, idf = weights.column("term").to_numpy().view(np.uint64), weights.column("idf").to_numpy()
        order = np.argsort(terms)
        index = Index(known, terms[order], idf[order], mean, stride)
        return pa.table({"stride": [stride], "part": [part], "image": [pickle.dumps(index)]})

    return run


def build(items: DataFrame) -> list[str]:
    """The files of an index of ``items`` (``item_id``, ``text``), built by tasks; none if no item has a word."""
    spark = items.sparkSession
    lean(spark)
    with scratch(spark):
        known = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        measured = known.where(F.col("text").isNotNull()).distinct()
        schema = "item_id long, text string, stride long, n_words long, terms array<long>"
        measured = cut(measured.mapInArrow(_measure, schema).where("n_words > 0"), "items")
        n, mean = measured.agg(F.count(F.lit(1)), F.avg("n_words")).first()
        if not n:
            return []
        weights = measured.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = weights.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        bytes_ = F.sum(F.octet_length("text"))
        sizes = measured.groupBy("stride").agg(F.ceil(bytes_ / F.lit(PART_BYTES)).alias("parts"))
        dealt = measured.join(F.broadcast(sizes), "stride").withColumn(  # one row a stride: fewer than 64
            "part", F.pmod(F.xxhash64("text", "item_id"), F.col("parts"))
        )
        own = dealt.select("stride", "part", F.explode("terms").alias("term")).distinct().join(weights, "term")
        own = cut(own, "weights")
        group = ["stride", "part"]
        index = (
            dealt.select(*group, "item_id", "text")
            .groupBy(*group)
            .cogroup(own.groupBy(*group))
            .applyInArrow(_build(mean), "stride long, part long, image binary")
        )
        return sorted(map(uri, cut(index, "index", keep=True).inputFiles()))


_held: dict[str, tuple[int, list[Index]]] = {}


def _indexes(files: list[str]) -> Iterator[Index]:
    """The parts one after the other; those that fit in ``HELD_BYTES`` together stay in this worker, the others are read
    again for the next batch.
    """
    for gone in _held.keys() - set(files):
        del _held[gone]
    for name in files:
        if name in _held:
            yield from _held[name][1]
            continue
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as f:
            images = pq.read_table(f, columns=["image"]).column(0).to_pylist()
        size, found = sum(map(len, images)), [pickle.loads(image) for image in images]
        if size + sum(n for n, _ in _held.values()) <= HELD_BYTES:
            _held[name] = (size, found)
        yield from found


def _best(files: list[str], texts: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
    """The best hit of each text and item id, over all parts."""
    best: dict[tuple[int, int | None], tuple[float, float, float]] = {}
    for index in _indexes(files):
        for text, item, score, q, w in index.hits(texts):
            key, row = (text, item), (min(q, w), score, q, w)
            if row > best.get(key, (-1.0,)):
                best[key] = row
    order = sorted(best, key=lambda k: (k[0], k[1] is None, k[1] or 0))
    return [(*k, *best[k][1:]) for k in order]


def _links(files: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*_best(files, batch.column(1)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    *(pa.array(c, k) for c, k in zip(columns[1:], (pa.int64(), *[pa.float64()] * 3), strict=True)),
                ],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return run


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and test item found in it: best score, question and answer overlap.

    An item is found where one passage holds its terms (half of its score at least) and half of the runs of three
    words of its question and of its answer; an item of one or two words, where those stand together.  Null,
    empty and wordless texts hold nothing, and such items are found nowhere.  Repeated documents are reported as
    often as they occur; an ``item_id`` that several texts have is found once, by the best of them; null ids stay
    null (items without an id share one link).  Very long texts are searched whole.  Extra columns are not read.
    No shuffle of documents: texts are searched where they are read, once.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    return picked.mapInArrow(_links(build(items)), schema)


def _clean(files: list[str], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in _best(files, batch.column(place).cast(pa.large_string()))]] = False
            yield batch.filter(pa.array(keep))

    return run


def keep_unseen(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, with the columns they came with; null and empty texts stay."""
    return docs.mapInArrow(_clean(build(items), docs.columns.index("text")), docs.schema)
