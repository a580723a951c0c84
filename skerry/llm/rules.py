"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per text and leaves a failure bit beside the measurements.  A policy is a mask of
bits under a version name: applying one, or asking what dropping a rule would change, never reads text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.storage import cut

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("shouting", "10 * n_shouts > 3 * n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << order[n] for n in names)


def _shifted(by: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: a.bitwiseXOR(F.shiftleft(b, by))


def _windows(words: str) -> Column:
    """A 64-bit hash of every five words in a row, from word hashes: pairs, then fours, then fives, shifted by
    their place.  No element is looked up by number.
    """
    left, n = F.col(words), F.size(words)
    span = 1
    for more in (1, 2, 1):
        right = F.col(words) if more == 1 else left
        size = F.greatest(n - (span + more - 1), F.lit(0))
        left = F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(span + 1), size), _shifted(span))
        span += more
    return left


def _covered(positions: Column) -> Column:
    """How many word positions windows of five words starting at the ascending ``positions`` cover."""
    gaps = F.transform(
        positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of each whole text; columns of the same names are replaced.

    Null text counts as empty: all measures 0.  The windows of one text are compared by a 64-bit hash of
    their words.  Work per text is a sort of its windows, and only where some window occurs twice.
    """
    docs = docs.select(F.struct(*docs.columns).alias("_row"))
    df = docs.withColumn("_text", F.coalesce(F.col(f"_row.{text}").cast("string"), F.lit("")))
    df = df.withColumns(
        {
            "_hash": F.transform(
                F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)
            ),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    df = df.withColumns(
        {
            "_windows": _windows("_hash"),
        }
    )
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "_again",
        F.array_sort(
            F.filter(
                F.transform(
                    "_sorted",
                    lambda x, k: F.when(
                        (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    counts = {
        "n_words": F.size("_hash"),
        "word_chars": F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(_covered(F.col("_again")), F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_shouts": F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit(""))),
    }
    # a generator of one row: a filter on the measures can't be pushed below it and repeat their expressions
    row = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    kept = [f"_row.{c}" for c in docs.schema["_row"].dataType.names if c not in (*counts, "fail_bits")]
    return df.select(*kept, F.inline(F.array(row)))


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``fail_bits`` (bit i: rule i of ``RULES`` fails).  No shuffle.

    Null and empty texts measure 0 and fail ``few_words``; repeated rows have equal entries; an empty table stays empty.
    """
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def passes(policy: str | tuple[str, ...] = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``ledger`` with ``policy_version`` and ``kept``."""
    return ledger.withColumns({"policy_version": F.lit(policy), "kept": passes(policy)})


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows whose text passes the policy, with the columns they came with: null and empty texts go, repeated rows share
    their fate, an empty table stays empty.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return rule_ledger(whole).where(passes(policy)).select("_row.*")


def stored(ledger: DataFrame) -> DataFrame:
    """The ledger, written once: policies and ablations read it again and no text."""
    return cut(ledger, "ledger")


def ablation(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: how many rows fail it, and how many would pass without it.

    One pass with partial sums over the bits; the result has one row per rule.
    """
    names = POLICIES[policy]
    whole = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = []
    for name in names:
        bit = F.lit(mask((name,))).cast("long")
        sums.append(F.count_if(whole.bitwiseAND(bit) != 0).alias(f"f_{name}"))
        sums.append(F.count_if(whole == bit).alias(f"o_{name}"))
    one = ledger.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"))
            for n in names
        ]
    )
    return one.select(F.lit(policy).alias("policy_version"), "n_rows", F.inline(rows))
