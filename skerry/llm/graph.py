"""Connected components of an edge table, by rounds of joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.storage import cut, drop


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a`` and ``b``); the root is the least node.

    Large-star and small-star rounds alternate until the edges stay as they are: a few rounds for the star-like
    edges made here, a logarithm of the longest path in general.  Neighbours are never gathered: a round takes
    a minimum per node (summed up before the shuffle) and joins it back (a hub is a skewed join, which Spark
    splits).  Each round is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.inline(
                F.array(
                    F.struct(b.alias("a"), F.col("m").alias("b")),
                    F.struct(a.alias("a"), F.col("m").alias("b")),
                )
            )
        )
        fresh = cut(small.where(a != b).distinct(), "edges")
        drop(edges)
        edges = fresh
    return edges.select(a.alias("node"), b.alias("root")).unionByName(
        edges.select(b.alias("node"), b.alias("root")).distinct()
    )
