"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of the hashed embeddings of itself and of its first bytes.  Filters of widths one to three
run over the words, each keeps its largest response in the whole text, and a logistic unit reads those.  The
embeddings do not start at random throughout: their first dimension starts from the log-odds of each bucket
between the classes of the training texts, one filter of each width passes it on, and training goes on from
there.  ``fit_all`` learns from all labelled texts: log-odds are counted over all of them, parts of the texts are
trained on in tasks from the same start, and the parts' models are averaged.  (``fit`` learns from a sample in one
process.)  Thresholds are set on labelled texts that the fit did not see, one for all and one for each language that
has enough of them.  The score never sees a language.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.storage import cut, fresh, lean, scratch

BUCKETS = 1 << 18
DIMENSIONS, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
#: Labelled texts of each class that are drawn, at most; one in five sets the thresholds.
TEXTS_PER_CLASS = 2400
#: Bytes of the texts of each class that are drawn, about, and of the longest text that is.
BYTES_PER_CLASS, TEXT_BYTES = 16 << 20, 1 << 20
EPOCHS, RATE, CALIBRATION = 4, 0.05, 5
CUT = 0.3
#: Bytes of the texts of a part that one task trains on, about, and passes over them.
PART_BYTES, PASSES = 8 << 20, 2
#: Steps of a logit in which thresholds are looked for, its largest size, and of a parameter when parts are averaged.
GRID, MOST, FINE = 1 << 10, 32, 1 << 32
#: Toxic texts that a language needs for a threshold of its own.
LANGUAGE_LEAST = 40
PAD = max(WIDTHS) - 1


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    scale: float = 1.0
    cuts: dict[str, float] = field(default_factory=dict)

    def logits(self, features: np.ndarray, first: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
        """``features``: (kinds, words) buckets; ``same``: place of each word of the texts in them."""
        vectors = self.embedding[features].sum(axis=0)
        n = np.diff(first)
        if same is None:
            same = np.arange(features.shape[1])
        starts = first[:-1] + PAD * np.arange(len(n))
        laid = np.zeros((len(same) + PAD * len(n) + PAD, DIMENSIONS), np.float32)
        laid[np.arange(len(same)) + np.repeat(PAD * np.arange(len(n)), n)] = vectors[same]
        size = len(laid) - PAD
        behind = ((starts + n)[:, None] + np.arange(PAD)).ravel()  # windows from here on hold no word of their text
        pooled = []
        for w, filters in zip(WIDTHS, self.filters, strict=True):
            response = laid[:size] @ filters[0]
            for j in range(1, w):
                response += laid[j : size + j] @ filters[j]
            response[behind] = 0
            pooled.append(np.maximum.reduceat(response, starts, axis=0))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return hidden @ self.out + self.out_bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = self.scale * (logits - self.shift) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each distinct word, bounds of texts, place of each word among the distinct ones)."""
    data, bounds = words.buffers(texts)
    hashes, first = words.hash_words(words.lower(data), bounds, words.LETTERS, PREFIXES)
    _, at, same = np.unique(hashes[0], return_index=True, return_inverse=True)
    return (hashes[:, at] & np.uint64(BUCKETS - 1)).astype(np.int64), first, same


def _odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket between the classes, drawn towards 0 where it is rare."""
    seen = np.zeros((2, BUCKETS))
    for buckets, label in zip(texts, labels, strict=True):
        seen[int(label), np.unique(buckets)] += 1
    return _log_odds(seen, np.bincount(labels.astype(int), minlength=2))


def _log_odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """From the texts of each class with a bucket, and all of each class."""
    n = np.maximum(texts, 1)
    return np.log((seen[1] + 3) / (n[1] + 6)) - np.log((seen[0] + 3) / (n[0] + 6))


def _start(rng: np.random.Generator, odds: np.ndarray | None) -> Model:
    """A model before training, with the log-odds of the buckets, if given."""
    model = Model(
        rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        -2.0,
    )
    if odds is not None:
        model.embedding[:, 0] += np.clip(odds, -2, 4) / 2
        for f in model.filters:
            f[0, 0, 0] = 1.0
        model.out[::FILTERS] = 0.5
    return model


def train(
    texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, odds: bool = True, start: Model | None = None
) -> Model:
    """``texts``: (kinds, words) buckets of each text; gradients flow through the largest responses only.
    ``odds``: whether the embeddings start from log-odds; ``start``: a model to go on from instead.
    """
    rng = np.random.default_rng(seed)
    model = copy.deepcopy(start) if start else _start(rng, _odds(texts, labels) if odds else None)
    sums = [np.full_like(f, 0.1) for f in model.filters]
    bias_sum, out_sum, out_bias_sum = np.full_like(model.bias, 0.1), np.full_like(model.out, 0.1), 0.1
    row_sum = np.full(BUCKETS, 0.1, np.float32)
    for epoch in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets = texts[i]
            n = buckets.shape[1]
            laid = np.zeros((n + 2 * PAD, DIMENSIONS), np.float32)
            for row in buckets:
                laid[:n] += model.embedding[row]
            size = n + PAD
            best, top = [], []
            for w, f in zip(WIDTHS, model.filters, strict=True):
                response = laid[:size] @ f[0]
                for j in range(1, w):
                    response += laid[j : size + j] @ f[j]
                at = response.argmax(axis=0)
                best.append(at)
                top.append(response[at, np.arange(FILTERS)])
            raw = np.concatenate(top) + model.bias
            hidden = np.maximum(raw, 0)
            z = float(hidden @ model.out) + model.out_bias
            wrong = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[i]
            rate = RATE / (1 + epoch)
            d_hidden = wrong * model.out * (raw > 0)
            d_out = wrong * hidden
            out_sum += d_out**2
            model.out -= rate * d_out / np.sqrt(out_sum)
            bias_sum += d_hidden**2
            model.bias -= rate * d_hidden / np.sqrt(bias_sum)
            out_bias_sum += wrong**2
            model.out_bias -= rate * wrong / np.sqrt(out_bias_sum)
            moved: dict[int, np.ndarray] = {}
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                d = d_hidden[k * FILTERS : (k + 1) * FILTERS]
                own = np.flatnonzero(d)
                if not len(own):
                    continue
                for j in range(w):
                    at = best[k][own] + j
                    for p, g in zip(at.tolist(), (f[j][:, own] * d[own]).T, strict=True):
                        moved[p] = moved.get(p, 0) + g
                    grad = np.zeros_like(f[j])
                    grad[:, own] = (laid[at] * d[own][:, None]).T
                    sums[k][j] += grad**2
                    f[j] -= rate * grad / np.sqrt(sums[k][j])
            for p, g in moved.items():
                if p < n:
                    rows = np.unique(buckets[:, p])
                    row_sum[rows] += float(g @ g)
                    model.embedding[rows] -= (rate / np.sqrt(row_sum[rows]))[:, None] * g
    return model


def _best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap between texts around it."""
    order = np.argsort(-logits)
    z, y, w = logits[order], labels[order], weights[order]
    hit, alarms = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (alarms + (w * y).sum())
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS, **training) -> Model | None:
    """A model from the labelled rows given (``doc_id``, ``toxic``); None if they lack one of the classes.

    At most ``per_class`` texts of each class are drawn, by a hash of ``doc_id``, until they have
    ``BYTES_PER_CLASS``; only their ids are joined to ``docs``.  Texts beyond ``TEXT_BYTES`` are not learned from
    (they are scored whole).  A ``doc_id`` with several labels counts as toxic if one says so, and one with
    several texts has the least of them; rows without an id or a label are passed over.
    """
    drawn = F.xxhash64("doc_id", F.lit("toxicity"))
    clear = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in clear.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not {0, 1} <= set(counts):
        return None
    picked = [clear.where(F.col("toxic") == c).orderBy(drawn, "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    before = F.sum(F.octet_length("text")).over(
        Window.partitionBy("toxic").orderBy(drawn, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    sample = (
        docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
        .where(F.octet_length("text") <= TEXT_BYTES)
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .where(F.col("before") < BYTES_PER_CLASS)
        .drop("before")
        .toPandas()
        .sort_values("doc_id")
    )
    if set(sample.toxic) != {0, 1}:
        return None
    label = sample.toxic.to_numpy(np.float64)
    column, texts = pa.array(sample.text, pa.large_string()), []
    sample = sample.drop(columns="text")
    for a, b in words.slices(column, 1 << 20):
        buckets, first, same = features(column.slice(a, b - a))
        buckets = buckets.astype(np.int32)
        texts += [buckets[:, same[x:y]] for x, y in zip(first[:-1], first[1:], strict=True)]
    del column
    turn = words.mix(sample.doc_id.to_numpy(np.int64).view(np.uint64)) % np.uint64(CALIBRATION)
    learn = np.flatnonzero((turn != 0) & np.array([t.shape[1] > 0 for t in texts]))
    check = np.flatnonzero(turn == 0)
    model = train([texts[i] for i in learn], label[learn], **training)
    if not len(check) or not 0 < label[check].sum() < len(check):
        check = np.arange(len(label))
    logits = np.array([float(model.logits(texts[i], np.array([0, texts[i].shape[1]]))[0]) for i in check])
    share = np.array([counts[0] / max(1, (label == 0).sum()), counts[1] / max(1, (label == 1).sum())])
    truth, weight, lang = label[check], share[label[check].astype(int)], sample.lang.to_numpy()[check]
    model.shift = _best_cut(logits, truth, weight)
    for name in {x for x in lang if isinstance(x, str)}:
        own = np.array([x == name for x in lang])
        if truth[own].sum() >= LANGUAGE_LEAST and (truth[own] == 0).sum() >= LANGUAGE_LEAST:
            model.cuts[name] = float(
                np.clip(model.scores(np.array([_best_cut(logits[own], truth[own], weight[own])]))[0], 0.1, 0.7)
            )
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text, lang, learn): every labelled text, whole; one in five sets the thresholds."""
    clear = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("text").isNotNull())
    return (
        rows.join(clear, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
        .withColumn("learn", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION)) != 0)
    )


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, none, some): texts of each class with a bucket; rows (toxic, text)."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        texts, labels = batch.column(1), batch.column(0).to_numpy()
        for a, b in words.slices(texts):
            buckets, first, same = features(texts.slice(a, b - a))
            for label, x, y in zip(labels[a:b], first[:-1], first[1:], strict=True):
                seen[label, np.unique(buckets[:, np.unique(same[x:y])])] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, seen[0, at], seen[1, at])], ["bucket", "none", "some"])
    words.release()


def _small(model: Model) -> np.ndarray:
    """The parameters but for the embeddings, in rows as long as those."""
    flat = np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.out, [model.out_bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _trained(shared):
    """What training on a part changes: (slot, v0, ...), rows of embeddings, then of the other parameters."""

    def run(table: pa.Table) -> pa.Table:
        start: Model = shared.value
        table = table.sort_by("doc_id").combine_chunks()
        column = pa.concat_arrays(table["text"].cast(pa.large_string()).chunks)
        texts: list[np.ndarray] = []
        for a, b in words.slices(column, 1 << 20):
            buckets, first, same = features(column.slice(a, b - a))
            buckets = buckets.astype(np.int32)
            texts += [buckets[:, same[x:y]] for x, y in zip(first[:-1], first[1:], strict=True)]
        label = table["toxic"].to_numpy().astype(np.float64)
        some = [i for i, t in enumerate(texts) if t.shape[1]]
        slots, moved = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS))
        if some:
            model = train([texts[i] for i in some], label[some], epochs=PASSES, start=start)
            rows = np.flatnonzero((model.embedding != start.embedding).any(axis=1))
            others = _small(model) - _small(start)
            slots = np.r_[rows, BUCKETS + np.arange(len(others))]
            moved = np.concatenate([model.embedding[rows].astype(np.float64) - start.embedding[rows], others])
        moved = np.rint(moved * FINE).astype(np.int64)
        out = pa.table({"slot": slots, **{f"v{i}": moved[:, i] for i in range(DIMENSIONS)}})
        words.release()
        return out

    return run


def _logits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(2), np.zeros(batch.num_rows)
            for a, b in words.slices(texts):
                found[a:b] = shared.value.logits(*features(texts.slice(a, b - a)))
            steps = np.rint(np.clip(found, -MOST, MOST) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(steps)], ["toxic", "lang", "step"])
        words.release()

    return run


def _cut_of(steps: np.ndarray, toxic: np.ndarray, texts: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap around it; counts of texts at each step."""
    order = np.argsort(-steps)
    z, hit, alarms = steps[order] / GRID, np.cumsum(toxic[order]), np.cumsum(texts[order])
    k = int(np.argmax(2 * hit / (alarms + hit[-1])))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def fit_all(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from every labelled text (``doc_id``, ``toxic`` 0 or 1), whole; None if they lack one of the classes.

    A ``doc_id`` with several labels counts as toxic if one says so, and one with several texts has the least of them;
    rows without an id, a text or a label are passed over.  Log-odds are counts over all learned texts.  Tasks go on from
    them, each over ``PART_BYTES`` of the texts, dealt by ``doc_id``; an embedding becomes the mean of the parts that
    changed it, the other parameters the mean of all parts, in whole steps, so the order of sums doesn't matter.
    Thresholds come from counts of all texts kept apart, at each step of the logit.  The driver gets counts of buckets,
    sums of parameters and counts of steps, whatever the number of texts.
    """
    spark = docs.sparkSession
    lean(spark)
    with scratch(spark):
        rows = cut(_labelled(docs, labels), "labelled")
        totals = rows.groupBy("learn", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
        many = {(r["learn"], r["toxic"]): r["n"] for r in totals}
        if not {0, 1} <= {toxic for _, toxic in many}:
            return None
        learned = rows.where("learn")
        seen = learned.select("toxic", "text").mapInArrow(_seen, "bucket long, none long, some long")
        sums = seen.groupBy("bucket").agg(F.sum("none").alias("none"), F.sum("some").alias("some")).toPandas()
        counts = np.zeros((2, BUCKETS))
        counts[:, sums.bucket] = sums.none, sums.some
        odds = _log_odds(counts, np.array([many.get((True, c), 0) for c in (0, 1)]))
        model = _start(np.random.default_rng(7), odds)
        start = spark.sparkContext.broadcast(model)  # BUCKETS * DIMENSIONS floats, whatever the input
        parts = -(-sum(r["bytes"] for r in totals if r["learn"]) // PART_BYTES) or 1
        dealt = learned.select("doc_id", "toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).alias("part"))
        named = [f"v{i}" for i in range(DIMENSIONS)]
        moved = dealt.groupBy("part").applyInArrow(_trained(start), ", ".join(["slot long", *(f"{v} long" for v in named)]))
        mean = moved.groupBy("slot").agg(*(F.sum(v).alias(v) for v in named), F.count(F.lit(1)).alias("n")).toPandas()
        steps = mean[named].to_numpy() / (FINE * mean["n"].to_numpy()[:, None])
        slot = mean["slot"].to_numpy()
        model = copy.deepcopy(model)
        model.embedding[slot[slot < BUCKETS]] += steps[slot < BUCKETS].astype(np.float32)
        small = _small(model)
        small[slot[slot >= BUCKETS] - BUCKETS] += steps[slot >= BUCKETS]
        flat, at = small.ravel(), 0
        for own in (*model.filters, model.bias, model.out):
            own[...] = flat[at : at + own.size].reshape(own.shape)
            at += own.size
        model.out_bias = float(flat[at])
        apart = {toxic for learn, toxic in many if not learn} >= {0, 1}
        checked = rows.where("NOT learn") if apart else rows
        found = checked.select("toxic", "lang", "text").mapInArrow(
            _logits(spark.sparkContext.broadcast(model)), "toxic int, lang string, step int"
        )
        found = cut(found.groupBy("lang", "step").agg(F.sum("toxic").alias("some"), F.count(F.lit(1)).alias("n")), "steps")
        whole = found.groupBy("step").agg(F.sum("some").alias("some"), F.sum("n").alias("n")).toPandas()
        model.shift = _cut_of(whole.step.to_numpy(), whole.some.to_numpy(), whole.n.to_numpy())
        enough = (F.sum("some") >= LANGUAGE_LEAST) & (F.sum(F.col("n") - F.col("some")) >= LANGUAGE_LEAST)
        langs = found.where("lang IS NOT NULL").groupBy("lang").agg(enough.alias("enough")).where("enough").select("lang")
        for name, own in found.join(langs, "lang").toPandas().groupby("lang"):
            least = _cut_of(own.step.to_numpy(), own.some.to_numpy(), own.n.to_numpy())
            model.cuts[name] = float(np.clip(model.scores(np.array([least]))[0], 0.1, 0.7))
        return model


def _score(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.zeros(len(texts))
            for a, b in words.slices(texts) if model else ():
                buckets, first, same = features(texts.slice(a, b - a))
                found[a:b] = model.scores(model.logits(buckets, first, same))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], column]
            )
        words.release()

    return run


def score(docs: DataFrame, model: Model | None, *carry: str, column: str = "_score") -> DataFrame:
    """The ``carry`` columns of ``docs`` (all, if none is named) with a score as ``column``: 0 to 1, higher is more toxic.

    The whole text counts, however long; null and empty texts score what a text without words scores; without a
    model every score is 0.  Repeated rows score alike.  A column named ``column`` is replaced.  An empty table
    gives no rows.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIMENSIONS floats, whatever the input
    kept = [c for c in carry or docs.columns if c.lower() != column.lower()]
    picked = docs.select(*kept, F.col("text").cast("string").alias(fresh(docs, "_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_score(shared, column), f"{schema}, `{column}` double")


def threshold(model: Model | None, lang: Column) -> Column:
    """The cut for a row's language: its own, or the common one."""
    out = F.lit(CUT)
    for name, cut in sorted((model.cuts if model else {}).items()):
        out = F.when(lang == name, F.lit(cut)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows below their language's threshold, with the columns they came with; a null or unknown language has
    the common threshold.  Rows without a text stay as far as a text without words does; repeated rows share their
    fate.
    """
    column = fresh(docs, "_score")
    return score(docs, model, column=column).where(F.col(column) < threshold(model, F.col("lang"))).select(*docs.columns)
