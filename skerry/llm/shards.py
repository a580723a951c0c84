"""Sharding by jump consistent hashing, in SQL functions only.

``assign_shards`` is a projection: no shuffle, no ring table.  ``shard_ledger`` adds the place of every row in
its shard; it never sorts a whole shard in one task: a shard is cut into hash buckets, the bucket sizes are
summed up (``shards * 2**BUCKET_BITS`` rows, whatever the input), and rows are numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The multiplier of the published 64-bit generator, in 32-bit halves.
MULTIPLIER_HIGH = 0x27BB2EE6
MULTIPLIER_LOW = 0x87B0B0FD

LOW32 = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of ``key * multiplier + 1`` modulo 2**64; no step leaves 63 bits, so ANSI mode holds."""
    p0 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW)
    p1 = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    total = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(p1, 16)
    cross = (
        F.shiftleft((F.shiftright(high, 16) * F.lit(MULTIPLIER_LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
        + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW)
    )
    new_high = (cross + (low * F.lit(MULTIPLIER_HIGH)).bitwiseAND(F.lit(LOW32)) + carry).bitwiseAND(F.lit(LOW32))
    return new_high, total.bitwiseAND(F.lit(LOW32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards - 1`` of a 64-bit key.

    The candidate jumps forward until it leaves the range; each jump moves at least one shard on, so
    ``shards`` steps are always enough (about ln(shards) of them do something).  A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(LOW32)).alias("low"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        jump = (state["next"] + 1).cast("double") * (
            F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        )
        moved = F.struct(
            state["next"].alias("at"), F.floor(jump).cast("long").alias("next"), high.alias("high"), low.alias("low")
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda state: state["at"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """Every row with its shard.  Other columns stay; one of the name ``column`` is replaced.

    Empty tables stay empty; repeated rows share their shard; a null key has the shard of key 0.
    """
    return docs.withColumn(column, jump_shard(F.col(key), shards))


BUCKET_BITS = 10


def _bucket(key: Column) -> Column:
    """The key's bits folded onto ``BUCKET_BITS``; runs of ids and multiples of powers of two spread alike."""
    key = F.coalesce(key, F.lit(0).cast("long"))
    folded = key
    for shift in range(BUCKET_BITS, 64, BUCKET_BITS):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(key, shift))
    return folded.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def shard_ledger(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: its shard, its shard with one more shard, and its place there, gapless from 0.

    Repeated rows are counted before the shuffle and laid out again from their count, so a row that makes up
    a third of the table moves as one row.  Null text: size 1, crc 0.  Extra columns are not carried.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )

    def placed(df: DataFrame) -> DataFrame:
        return assign_shards(df, shards).withColumn("bucket", _bucket(F.col("doc_id")))

    in_shard = Window.partitionBy("shard").orderBy("bucket")
    starts = (
        placed(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
        .groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", (F.sum("n").over(in_shard) - F.col("n")).alias("start"))
    )
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = placed(keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return (
        rows.withColumn("before", before)
        .join(F.broadcast(starts), ["shard", "bucket"])  # at most shards * 2**BUCKET_BITS rows
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("before") + F.col("copy")).cast("long").alias("slot"),
            jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        )
    )
