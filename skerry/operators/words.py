"""Word errors of transcripts: long form, alignment counts and the leaderboard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.columns import normalise


def to_long(wide: DataFrame, ids: list[str], prefix: str = "pred_text_") -> DataFrame:
    """(ids, model, pred_text) from the columns that begin with ``prefix``."""
    found = [c for c in wide.columns if c.startswith(prefix)]
    named = wide.select(*ids, *[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in found])
    return named.unpivot(ids, [F.col(f"`{c.removeprefix(prefix)}`") for c in found], "model", "pred_text")


# A cell of an alignment: its cost, two bits that put a pair of words before a deletion before an insertion where costs are
# equal, and its hits.  The other counts follow from those and the lengths.
_COST, _DELETED, _INSERTED = 1 << 32, (1 << 32) + (1 << 30), (1 << 32) + (2 << 30)
_PLAIN = ~np.int64(3 << 30)
#: Cells of an anti-diagonal, over all pairs that are aligned together.
CELLS = 1 << 17


def _align(refs: list[list[int]], said: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cost, hits) of pairs of word numbers, all anti-diagonal by anti-diagonal together."""
    n, m = np.array([len(r) for r in refs]), np.array([len(s) for s in said])
    rows, columns, pairs = int(n.max()), int(m.max()), len(refs)
    a, b = np.full((rows, pairs), -1, np.int32), np.full((columns, pairs), -2, np.int32)
    for k, (r, s) in enumerate(zip(refs, said, strict=True)):
        a[: len(r), k] = r
        b[columns - len(s) :, k] = s[::-1]  # the last row has the first word
    end, out = n + m, np.zeros(pairs, np.int64)
    now, before, older = (np.zeros((rows + 1, pairs), np.int64) for _ in range(3))
    for k in range(1, rows + columns + 1):
        now, before, older = older, now, before
        low, high = max(1, k - columns), min(rows, k - 1)
        if low <= high:
            equal = a[low - 1 : high] == b[columns - k + low : columns - k + high + 1]
            best = older[low - 1 : high] + np.where(equal, 1, _COST)
            np.minimum(best, before[low - 1 : high] + _DELETED, out=best)
            np.minimum(best, before[low : high + 1] + _INSERTED, out=best)
            np.bitwise_and(best, _PLAIN, out=now[low : high + 1])
        if k <= columns:
            now[0] = k * _COST
        if k <= rows:
            now[k] = k * _COST
        done = np.flatnonzero(end == k)
        out[done] = now[n[done], done]
    return out >> 32, out & (_COST - 1)


def counts(reference: list[str], said: list[str]) -> np.ndarray:
    """A row (hits, substitutions, deletions, insertions) for each pair of texts: those of a least-cost alignment of their
    words where, of equal costs, a pair of words goes before a deletion, and that before an insertion.

    Pairs of like lengths are aligned together, ``CELLS`` cells of an anti-diagonal at a time.
    """
    known: dict[str, int] = {}
    numbered = [[[known.setdefault(w, len(known)) for w in t.split()] for t in side] for side in (reference, said)]
    refs, others = numbered
    n, m = (np.array([len(t) for t in side], np.int64) for side in numbered)
    cost, hits = np.zeros(len(refs), np.int64), np.zeros(len(refs), np.int64)
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        size, longest = 1, n[order[at]] + 1
        while at + size < len(order) and (size + 1) * (n[order[at + size]] + 1) <= CELLS and n[order[at + size]] <= longest * 5 // 4 + 8:
            size += 1
        part = order[at : at + size]
        part = part[np.argsort(m[part], kind="stable")]
        for own in np.array_split(part, max(1, len(part) // 64)):  # like lengths on the other side, too
            cost[own], hits[own] = _align([refs[i] for i in own], [others[i] for i in own])
        at += size
    insertions, deletions = cost - n + hits, cost - m + hits
    return np.stack((hits, n - hits - deletions, deletions, insertions), axis=1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = counts(list(batch.pop("_reference")), list(batch.pop("_said")))
        batch[["hits", "substitutions", "deletions", "insertions"]] = pd.DataFrame(found, columns=list("hsdi"), index=batch.index)
        yield batch


def word_errors(rows: DataFrame, reference: str, said: str) -> DataFrame:
    """``rows`` without both texts, with the counts of a least-cost alignment of their normalised words and
    ``wer`` in percent (null for an empty reference).
    """
    carry = [c for c in rows.columns if c not in (reference, said)]
    picked = rows.select(
        *carry,
        normalise(F.coalesce(reference, F.lit(""))).alias("_reference"),
        normalise(F.coalesce(said, F.lit(""))).alias("_said"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[: len(carry)])
    # work grows with the square of the words, not with bytes: spread rows over all partitions
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = picked.repartition(n, *carry).mapInPandas(
        _count, f"{schema}, hits long, substitutions long, deletions long, insertions long"
    )
    return counted.withColumn("wer", rate())


def rate():
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    said = F.col("hits") + F.col("substitutions") + F.col("deletions")
    return F.round(F.try_divide(wrong * 100.0, said), 2)


def leaderboard(samples: DataFrame) -> DataFrame:
    """Word error rate of each model over all its samples, best first."""
    kinds = ("hits", "substitutions", "deletions", "insertions")
    return (
        samples.groupBy("model")
        .agg(*[F.sum(k).alias(k) for k in kinds])
        .select("model", F.expr("hits + substitutions + deletions").alias("n_words"), *kinds[1:], rate().alias("wer"))
        .orderBy("wer", "model")
    )
