"""Rule tables: stored scope and conditions as JSON, and the operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.tables import Rule, changed_rules, insert_absent

# Fields and names of stored rules.
SCOPE = "level string, target_feeds array<string>"
CONDITIONS = (
    "evaluation_type string, operator string, case_sensitive boolean, keywords array<string>, expression string, "
    "flags string, child_rule_ids array<string>"
)
KINDS = {"KEYWORD_MATCH": "keyword", "REGEX_MATCH": "regex", "RULE_GROUP": "group"}
#: Rules that may be made into expressions; they are configuration, not data.
MOST_RULES = 10_000


def parse(stored: DataFrame) -> DataFrame:
    """Stored rules (``rule_id``, ``is_active``, ``scope``, ``conditions``, both JSON) in columns, with their
    defaults; ``error`` says what is wrong with a row.  A null ``is_active`` counts as true.
    """
    scope, conditions = F.from_json("scope", SCOPE), F.from_json("conditions", CONDITIONS)
    kind = F.col("_conditions.evaluation_type")
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    needed = F.when(kind == "KEYWORD_MATCH", F.col("_conditions.keywords").isNull())
    needed = needed.when(kind == "REGEX_MATCH", F.col("_conditions.expression").isNull())
    needed = needed.when(kind == "RULE_GROUP", F.col("_conditions.child_rule_ids").isNull())
    error = F.when(F.coalesce(~F.col("_scope.level").isin("GLOBAL", "FEED_SPECIFIC"), F.lit(True)), F.lit("bad scope"))
    error = error.when(F.coalesce(~kind.isin(*KINDS), F.lit(True)), F.lit("bad evaluation type"))
    error = error.when(needed, F.lit("bad conditions"))
    return stored.withColumns({"_scope": scope, "_conditions": conditions}).select(
        "rule_id",
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.col("_scope.level").alias("level"),
        F.coalesce("_scope.target_feeds", F.array()).cast("array<string>").alias("target_feeds"),
        F.try_element_at(names, F.coalesce(kind, F.lit(""))).alias("kind"),
        F.coalesce("_conditions.operator", F.lit("ANY")).alias("operator"),
        F.coalesce("_conditions.case_sensitive", F.lit(False)).alias("case_sensitive"),
        F.coalesce("_conditions.keywords", F.array()).cast("array<string>").alias("keywords"),
        F.coalesce("_conditions.expression", F.lit("")).alias("expression"),
        F.coalesce("_conditions.flags", F.lit("i")).alias("flags"),
        F.coalesce("_conditions.child_rule_ids", F.array()).cast("array<string>").alias("children"),
        error.alias("error"),
    )


def load(parsed: DataFrame) -> list[Rule]:
    """The rules that are right, by id, for ``tables.evaluate``.  More than ``MOST_RULES`` fail."""
    rows = parsed.where(F.col("error").isNull()).orderBy("rule_id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [
        Rule(
            r.rule_id, r.kind, tuple(r.keywords), r.operator, r.case_sensitive, r.expression, r.flags,
            tuple(r.children), r.is_active, r.level, tuple(r.target_feeds),
        )
        for r in rows
    ]


def create(rules: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new rules; one whose id is there already stays as it is."""
    return insert_absent(rules, new, "rule_id")


def get(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("rule_id") == rule_id)


def listed(rules: DataFrame, active: bool = False) -> DataFrame:
    """All rules, or the active ones, by id."""
    return (rules.where("is_active") if active else rules).orderBy("rule_id")


def update(rules: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The table with the non-null fields of ``changes`` put in."""
    return changed_rules(rules, changes, now)


def delete(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the rules that ``gone`` names."""
    return rules.join(gone, "rule_id", "left_anti")
