"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Every stage works on all that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import decontaminate, neardup, packing, queries, rules, toxicity
from skerry.llm.storage import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below their language's toxicity threshold; null and empty texts score as texts without words.

    Repeated rows share their fate; without labels of both classes all rows stay; an empty table stays empty.
    """
    model = queries.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the current policy; null and empty texts have too few words and go."""
    return rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal and near-equal texts: the least ``doc_id``, null last; null text is empty.

    Different texts under one id all stay; of repeated rows one stays.
    """
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item; null and empty texts stay, repeated rows share their fate."""
    return decontaminate.keep_unseen(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts that are left, with their sequence and place; a null or empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express the trained and hashed stages.  tests/llm runs every stage on a small table against plain
#: Python: rules, all pairs, all passages and the library's ids; the scores of toxicity are taken as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
