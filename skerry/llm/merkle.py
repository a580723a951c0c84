"""A Merkle manifest of a dataset: leaves of rows, a tree for every run (language), a tree over the runs' roots.

Digests are lowercase hex of sha256; the digest of several is that of their hex texts one after the other.  Every two
consecutive nodes of a run become their digest, a last one alone too, until one is left.

A run is never in one task.  Its rows are numbered over ranges, and trees grow by blocks of ``2**LEVELS`` slots: inside
a block every level is one window over (run, block).  Nodes live on the rows of their first leaf; ``lag`` and ``lead`` by
the level's fixed offset, masked by slot and run length, fetch the sibling, and the row of the first child hashes the
parent.  Block roots are the leaves of the next round: a billion rows take four rounds.  On the way down a node's proof
is its sibling and its parent's proof, which lies on its own row or one fixed offset before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.storage import cut, drop

#: Levels of a block: windows hold at most ``2**LEVELS`` rows.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of the ids that Spark numbers the rows of a partition by


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as text that no other value has: ``-`` for null, else its UTF-8 bytes' count, a colon and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(values[c]) for c in FIELDS]))


def run_key(value: Column) -> Column:
    """A run's name as text that is never null: null goes first, others stay in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, the place in the row's ``run`` from 0, and ``n``, the run's length.

    Rows are dealt out to ranges by run, order and a number of their own, so not even a row that repeats fills a task;
    what stands before a range is summed up from one count for each range and run.
    """
    own = F.monotonically_increasing_id()
    keys = [F.col(c).asc_nulls_first() for c in ("run", *order, "_own")]
    known = cut(rows.withColumn("_own", own), "merkle-rows")  # numbers and ranges must not change any more
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(known.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_own", own), "merkle-ranges")
    drop(known)
    part = F.shiftright("_own", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part"), F.col("run").alias("_run")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_first")
    )
    w = Window.partitionBy("_run")
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select("_part", "_run", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    fits = (part == F.col("_part")) & (F.col("run") == F.col("_run"))
    return ranged.join(starts, fits).select(*rows.columns, (F.col("_own") + F.col("_shift")).alias("slot"), "n")


def _up(rows: DataFrame) -> DataFrame:
    """``rows`` (run, slot, n, node) with ``block``, the siblings ``_s0`` to ``_s7`` of the nodes that begin at a row,
    as the side where they stand and their digest, and ``node``, on a block's first row the block's root.
    """
    size = 1 << LEVELS
    df = rows.withColumns({"block": F.shiftright("slot", LEVELS), "_at": F.col("slot") % size, "_node": F.col("node")})
    w = Window.partitionBy("run", "block").orderBy("slot")
    for level in range(LEVELS):
        offset = 1 << level
        begins, right = F.col("_at") % offset == 0, F.col("_at") % (2 * offset) != 0
        left_one, right_one = F.lag("_node", offset).over(w), F.lead("_node", offset).over(w)
        more = F.col("slot") + offset < F.col("n")
        df = df.withColumns({"_l": F.when(begins & right, left_one), "_r": F.when(begins & ~right & more, right_one)})
        # a run of one node is its own root
        parent = F.when(F.col("n") <= offset, F.col("_node")).otherwise(digest(F.concat("_node", F.coalesce("_r", F.lit("")))))
        side = F.coalesce(F.concat(F.lit("L"), F.col("_l")), F.concat(F.lit("R"), F.col("_r")))
        # a node without a sibling still is hashed into its parent
        alone = F.when(begins & (F.col("n") > offset), F.lit("-"))
        df = df.withColumns({f"_s{level}": F.coalesce(side, alone), "_node": F.when(begins & ~right, parent)})
    return df.drop("_l", "_r")


def _down(up: DataFrame) -> DataFrame:
    """``path`` on every row: the steps from it to its block's root."""
    w = Window.partitionBy("run", "block").orderBy("slot")
    df = up.withColumn("path", F.when(F.col("_at") == 0, F.array().cast("array<string>")))
    for level in range(LEVELS - 1, -1, -1):
        offset = 1 << level
        begins, right = F.col("_at") % offset == 0, F.col("_at") % (2 * offset) != 0
        above = F.when(right, F.lag("path", offset).over(w)).otherwise(F.col("path"))
        own = F.array_compact(F.array(f"_s{level}"))
        df = df.withColumn("path", F.when(begins, F.concat(own, above)))
    return df.drop(*[f"_s{level}" for level in range(LEVELS)], "_at", "_node")


def climb(rows: DataFrame, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (run, slot, n, node and more) with ``path``, the steps from each row to the root, ``subroot``, its run's
    root, and ``root``.

    ``crown`` gives (run, subroot, root, above) for the runs' roots (run, node), ``above`` the steps from them on.  All
    joins are on (run, block), at most ``2**LEVELS`` rows of one side, however long a run is.
    """
    up = _up(rows)
    longest = rows.agg(F.max("n")).first()[0] or 0
    if longest <= 1 << LEVELS:
        tops = crown(up.where("slot = 0").select("run", F.col("_node").alias("node"))).withColumn("_block", F.lit(0))
    else:
        roots = up.where("_at = 0").select(
            "run",
            F.col("block").alias("slot"),
            F.shiftright(F.col("n") + (1 << LEVELS) - 1, LEVELS).alias("n"),
            F.col("_node").alias("node"),
        )
        tops = climb(cut(roots, "merkle-roots"), crown).withColumnsRenamed({"slot": "_block", "path": "above"})
    above = tops.select(F.col("run").alias("_run"), F.col("_block").cast("long"), "above", "subroot", "root")
    fits = (F.col("run") == F.col("_run")) & (F.col("block") == F.col("_block"))
    return _down(up).join(above, fits).select(*rows.columns, F.concat("path", "above").alias("path"), "subroot", "root")


def _no_crown(tops: DataFrame) -> DataFrame:
    return tops.select("run", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("above"))


def _crown(tops: DataFrame) -> DataFrame:
    """The tree over the runs' roots, in the order of the runs."""
    named = tops.select(F.lit("").alias("run"), F.col("run").alias("_name"), "node")
    whole = climb(numbered(named, ["_name"]), _no_crown)
    return whole.select(F.col("_name").alias("run"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""

    def step(node: Column, s: Column) -> Column:
        sibling, side = F.substring(s, 2, 64), F.substring(s, 1, 1)
        left = F.when(side == "L", sibling).otherwise(F.lit(""))
        right = F.when(side == "R", sibling).otherwise(F.lit(""))
        return digest(F.concat(left, node, right))

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The digests of a proof, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, lang, slot, leaf, subroot, root, path, changed_leaf).

    Leaves stand in their language's run by ``doc_id``, null first, ties by their digest; a null language is a run of its
    own, and runs stand null first, then by their bytes.  ``path`` has the steps from the leaf to the root: the side of the
    sibling (L, R) and its digest, or ``-`` where a node has none.  ``changed_leaf`` is the leaf with the ``changed``
    columns in place of the row's.  Null and empty values differ; repeated rows are leaves of their own; columns other than
    ``FIELDS`` don't count; an empty table gives no rows.
    """
    own = {c: F.col(c) for c in FIELDS}
    leaves = docs.select(
        "doc_id", run_key(F.col("lang")).alias("run"), leaf(own).alias("node"), leaf(own | (changed or {})).alias("changed_leaf")
    )
    return climb(numbered(leaves, ["doc_id", "node"]), _crown).select(
        "doc_id",
        F.when(F.col("run") != "", F.substring("run", 2, 1 << 30)).alias("lang"),
        "slot",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "path",
        "changed_leaf",
    )


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of ``manifest`` with ``proof_sha256``, ``folded_root`` (from ``changed_leaf``) and whether it is the root."""
    fold = rows.withColumns({"proof_sha256": digest(siblings(F.col("path"))), "folded_root": folded(F.col("changed_leaf"), F.col("path"))})
    return fold.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "changed_leaf")
