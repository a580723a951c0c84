"""Language of a text by prediction by partial matching over bytes.

Per language a tree of byte contexts up to ``ORDER`` with their counts, frozen after training.  A byte costs
-log2 of its probability in its longest known context; where the context has never been followed by it, the
escape probability (method C) is paid and the next shorter context is asked.  The text's language is the one
with the least code length.  The cost depends on ``ORDER + 1`` bytes alone, so workers remember the exact costs
of byte windows and walk the trees once per new window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.storage import fresh, lean

ORDER = 4
#: Training texts of a language, about; each goes in whole.
TEXTS_PER_LANGUAGE = 600
#: Bytes of the training texts of a language and of all languages, about, and of the longest training text.
LANGUAGE_BYTES, SAMPLE_BYTES, TEXT_BYTES = 4 << 20, 64 << 20, 1 << 20
SLOTS = 1 << 19


def windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` before it, as one number; zeros before the start of a text."""
    out = data.astype(np.uint64)
    n = len(data)
    since = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, ORDER + 1):
        before = np.zeros(n, np.uint64)
        before[k:] = data[: n - k]
        before[since < k] = 0
        out |= before << np.uint64(8 * k)
    return out


@dataclass
class Tree:
    """Counts of one language: per order the known (context, byte) numbers and the known contexts."""

    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, seen: np.ndarray) -> Tree:
        """``seen``: the windows of all training texts of the language."""
        tree = cls()
        gram, count = np.unique(seen, return_counts=True)
        for k in range(ORDER + 1):
            cover = np.uint64((1 << 8 * (k + 1)) - 1)
            own, back = np.unique(gram & cover, return_inverse=True)
            n = np.bincount(back, weights=count, minlength=len(own))
            context, back = np.unique(own >> np.uint64(8), return_inverse=True)
            tree.grams.append(own)
            tree.counts.append(n)
            tree.contexts.append(context)
            tree.totals.append(np.bincount(back, weights=n, minlength=len(context)))
            tree.kinds.append(np.bincount(back, minlength=len(context)).astype(np.float64))
        return tree

    def cost(self, window: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each window."""
        out, open_ = np.zeros(len(window)), np.ones(len(window), bool)
        for k in range(ORDER, -1, -1):
            gram = window & np.uint64((1 << 8 * (k + 1)) - 1)
            context = gram >> np.uint64(8)
            if not len(self.contexts[k]):
                continue
            c = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            g = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            known = open_ & (self.contexts[k][c] == context)
            hit = known & (self.grams[k][g] == gram)
            whole = self.totals[k][c] + self.kinds[k][c]
            out[hit] -= np.log2(self.counts[k][g[hit]] / whole[hit])
            missed = known & ~hit
            out[missed] -= np.log2(self.kinds[k][c[missed]] / whole[missed])
            open_ &= ~hit
        out[open_] += 8
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


class Scorer:
    """Exact code lengths with a direct-mapped memory of windows."""

    def __init__(self, model: Model, slots: int = SLOTS):
        self.model, self.slots = model, slots
        self.keys = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.costs = np.zeros((slots, len(model.trees)), np.float32)

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, languages) code lengths."""
        total = np.zeros((len(bounds) - 1, len(self.model.trees)))
        if not len(data):
            return total
        window = windows(data, bounds)
        slot = (words.mix(window) & np.uint64(self.slots - 1)).astype(np.int64)
        costs = self.costs[slot]
        missed = np.flatnonzero(self.keys[slot] != window)
        if len(missed):
            fresh, back = np.unique(window[missed], return_inverse=True)
            found = np.stack([t.cost(fresh) for t in self.model.trees], axis=1).astype(np.float32)
            costs[missed] = found[back]
            at = (words.mix(fresh) & np.uint64(self.slots - 1)).astype(np.int64)
            self.keys[at], self.costs[at] = fresh, found
            # two fresh windows may share a slot: the key that stayed decides whose costs stay
            self.costs[at] = found[np.searchsorted(fresh, self.keys[at])]
        some = np.flatnonzero(np.diff(bounds) > 0)
        total[some] = np.add.reduceat(costs, bounds[some], axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Trees from at most about ``per_language`` texts of each language of ``docs`` (``text`` and non-null
    ``lang``), picked by a hash until they have ``LANGUAGE_BYTES`` (or their share of ``SAMPLE_BYTES``); texts
    beyond ``TEXT_BYTES`` are not learned from.  Statistics stay frozen afterwards.  No such text, no language.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= TEXT_BYTES))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    before = F.sum(F.octet_length("text")).over(
        Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1)
    )
    most = min(LANGUAGE_BYTES, SAMPLE_BYTES // max(1, len(counts)))
    sample = (
        known.where(draw < share)
        .select("lang", "text", draw.alias("draw"))
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .where(F.col("before") < most)
        .select("lang", "text")
        .toPandas()
    )
    languages = sorted(counts)
    trees = []
    for lang in languages:
        data, bounds = words.buffers(pa.array(sample.text[sample.lang == lang], pa.large_string()))
        trees.append(Tree.of(windows(data, bounds)))
    return Model(languages, trees)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            langs: list[str] = []
            scores: list[float] = []
            for a, b in words.slices(texts, 1 << 20):
                part = texts.slice(a, b - a)
                bits = scorer.bits(*words.buffers(part)) if model.trees else np.zeros((b - a, 1))
                gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * np.log(2), 700)
                best, chance = bits.argmin(axis=1), 1 / np.exp(-gap).sum(axis=1)
                for text, k, p in zip(part, best.tolist(), chance.tolist(), strict=True):
                    letters = model.trees and any(map(str.isalpha, text.as_py() or ""))
                    langs.append(model.languages[k] if letters else "und")
                    scores.append(p if letters else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score`` (its posterior probability) of each whole ``text``.

    ``und`` with score 0 for null texts, texts without a letter, or an empty model.  Texts are scored whole, in
    slices of about a megabyte; a longer text is a slice of its own.  Ties go to the first language by name.
    Repeated rows score alike; an empty table gives no rows.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    picked = docs.select(*carry, F.col("text").cast("string").alias(fresh(docs, "_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_predict(shared), f"{schema}, lang_pred string, score double")
