"""Quantiles of groups of any size.

Spark's KLL sketches are partial aggregates: every task keeps one of fixed size per group, and the shuffle carries sketches,
not values.  Sketches of groups merge into those of larger ones.  A rank that a sketch of ``SKETCH_K`` gives is off by less
than ``RANK_ERROR`` of the rows (about 0.4 % at 99 % confidence), and exact up to as many rows as it holds.

Where the exact value is wanted, the sketch says between which two values it lies; one more pass counts what is below and
ranks only the few rows between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources import scratch

SKETCH_K, RANK_ERROR = 800, 0.01
#: Rows of a group that a plain aggregate may hold.
PLAIN = 1 << 20


def _known(value: str) -> Column:
    """Values that have a rank: neither null nor NaN."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def sketches(df: DataFrame, keys: list[str], value: str, name: str = "sketch") -> DataFrame:
    """(keys, n, sketch): how many values a group has, and their sketch (null without any).  Null keys are a group."""
    n, sketch = F.count(_known(value)), F.kll_sketch_agg_double(_known(value), F.lit(SKETCH_K))
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n > 0, sketch).alias(name))


def merged(held: DataFrame, keys: list[str], name: str = "sketch") -> DataFrame:
    """The sketches of larger groups (no keys: of all rows), from those of smaller ones, without their rows."""
    return held.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(name).alias(name))


def quantile(sketch: Column, q: float) -> Column:
    """The value of rank ``q``, within ``RANK_ERROR``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))


def _renamed(df: DataFrame, keys: list[str], *others: Column | str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *others)


def within_error(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``estimates`` (keys, n, a column for each name of ``shares``) with ``n_within``: how many of them have a rank that
    is their share of the rows, give or take ``RANK_ERROR`` and one row.
    """
    marks = []
    for name in shares:
        marks += [F.count_if(F.col("_v") < F.col(name)).alias(f"_below_{name}"), F.count_if(F.col("_v") <= F.col(name)).alias(f"_to_{name}")]
    rows = df.select(*keys, _known(value).alias("_v")).where(F.col("_v").isNotNull())
    ranks = rows.join(_renamed(estimates, keys, *shares), _same(keys)).groupBy(*keys).agg(*marks)
    slack = F.col("n") * RANK_ERROR + 1
    ok = [
        ((F.col(f"_below_{name}") <= q * F.col("n") + slack) & (F.col(f"_to_{name}") >= q * F.col("n") - slack)).cast("long")
        for name, q in shares.items()
    ]
    joined = estimates.join(_renamed(ranks, keys, *[c for c in ranks.columns if c not in keys]), _same(keys), "left")
    return joined.select(*estimates.columns, F.coalesce(reduce(lambda a, b: a + b, ok), F.lit(0)).cast("long").alias("n_within"))


def _interpolated(q: float, low: Column, high: Column) -> Column:
    place = F.lit(float(q)) * (F.col("n") - 1)
    return low + (high - low) * (place - F.floor(place))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """(keys, n, quantile): the exact value of rank ``q``, between two rows in proportion; null for a group without values.

    Groups of up to ``PLAIN`` rows are plain aggregates.  With a larger one, all go through sketches: rows outside a
    sketch's bounds are only counted, those inside (about ``2 * RANK_ERROR`` of a group) are ranked.  Should the bounds of a
    group miss its rank, that group alone is done by the plain aggregate.
    """
    rows = df.select(*keys, _known(value).alias("_v"))
    plain = [F.count("_v").alias("n"), F.percentile("_v", F.lit(float(q))).alias(name)]
    if rows.groupBy(*keys).count().where(F.col("count") > PLAIN).isEmpty():
        return rows.groupBy(*keys).agg(*plain)
    held = sketches(rows, keys, "_v")
    low, high = quantile(F.col("sketch"), max(q - RANK_ERROR, 0.0)), quantile(F.col("sketch"), min(q + RANK_ERROR, 1.0))
    bounds = scratch.written(held.select(*keys, "n", low.alias("_low"), high.alias("_high")), "bounds")
    joined = rows.join(_renamed(bounds, keys, "_low", "_high", "n"), _same(keys))
    below = _renamed(joined.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below")), keys, "_below")
    near = joined.where(F.col("_v").between(F.col("_low"), F.col("_high"))).select(*keys, "_v", "n")
    w = Window.partitionBy(*keys).orderBy("_v") if keys else Window.orderBy("_v")
    ranked = near.withColumn("_at", F.row_number().over(w) - 1).join(below, _same(keys)).withColumn("_at", F.col("_at") + F.col("_below"))
    first = F.floor(F.lit(float(q)) * (F.col("n") - 1))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_at") == first, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_at") == F.least(first + 1, F.col("n") - 1), F.col("_v"))).alias("_b"),
    )
    found = bounds.join(_renamed(picked, keys, "_a", "_b"), _same(keys), "left")
    value_of = F.coalesce(_interpolated(q, F.col("_a"), F.col("_b")), F.col("_a"))
    exact = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), value_of)
    done = scratch.written(found.select(*keys, "n", exact.alias(name)), "quantiles")
    missed = done.where((F.col("n") > 0) & F.col(name).isNull())
    if missed.isEmpty():
        return done
    again = rows.join(_renamed(missed, keys), _same(keys), "left_semi").groupBy(*keys).agg(*plain)
    return done.where((F.col("n") == 0) | F.col(name).isNotNull()).unionByName(again)
