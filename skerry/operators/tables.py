"""Rules, dead letters, alerts, leases and manifests as DataFrame to DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.config import LeaseConfig
from skerry.functions import columns as C
from skerry.operators import streams


@dataclass(frozen=True)
class Rule:
    """``kind``: keyword, regex or group.  Groups match nothing unless asked to."""

    rule_id: str
    kind: str
    keywords: tuple[str, ...] = ()
    operator: str = "ANY"
    case_sensitive: bool = False
    expression: str = ""
    flags: str = "i"
    children: tuple[str, ...] = field(default=())
    is_active: bool = True
    level: str = "GLOBAL"
    target_feeds: tuple[str, ...] = ()


# Fixed value: the built-in rule.
BUILT_IN = Rule("basic_fire_terms", "regex", expression=r"\b(fire|burn|evacuation|spreading)\b")


def matches(rule: Rule, text: Column, rules: dict[str, Rule], groups: bool = False) -> Column:
    """Whether a rule holds for a text.  ``\\b`` and ``\\w`` take all letters for letters."""
    if rule.kind == "regex":
        return text.rlike(("(?iU)" if "i" in rule.flags else "(?U)") + rule.expression)
    if rule.kind == "keyword":
        words = F.array(*[F.lit(k) for k in rule.keywords]).cast("array<string>")
        return C.keyword_match(text, words, F.lit(rule.operator == "ALL"), F.lit(rule.case_sensitive))
    if rule.kind == "group" and groups:
        parts = [matches(rules[c], text, rules) for c in rule.children]
        out = F.lit(rule.operator == "ALL")
        for p in parts:
            out = (out & p) if rule.operator == "ALL" else (out | p)
        return out
    return F.lit(False)


def evaluate(
    texts: DataFrame, rules: list[Rule], text: str = "text", groups: bool = False, feed: str | None = None
) -> DataFrame:
    """``texts`` with ``decisions``: the ids of the active rules that hold, in rule order.

    Rules are configuration, so every rule is one expression of a single projection: texts are not multiplied
    by rules and nothing is shuffled.  Blank texts have no decisions.  With ``feed`` the rules' scopes count.
    """
    known = {r.rule_id: r for r in rules}
    t, hits = F.coalesce(F.col(text), F.lit("")), []
    for r in rules:
        if r.is_active:
            holds = matches(r, t, known, groups)
            if feed and r.level == "FEED_SPECIFIC":
                holds = holds & F.col(feed).isin(*r.target_feeds)
            hits.append(F.when(holds, F.lit(r.rule_id)))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    decisions = F.when(C.not_blank(t), found).otherwise(F.array().cast("array<string>"))
    # a generator of one row: a filter on the decisions can't be pushed below it and evaluate every rule again
    kept = [c for c in texts.columns if c != "decisions"]
    return texts.select(*kept, F.inline(F.array(F.struct(decisions.alias("decisions")))))


def flagged(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.size("decisions") > 0)


def with_error(messages: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """``error``: the first check that fails (its column is true), or null."""
    error = F.lit(None).cast("string")
    for broken, reason in reversed(checks):
        error = F.when(F.coalesce(broken, F.lit(True)), F.lit(reason)).otherwise(error)
    return messages.withColumn("error", error)


def dead_letters(checked: DataFrame, feed: Column, stage: str) -> DataFrame:
    """Rows with an error as dead letters; further columns come from the row as JSON."""
    body = F.to_json(F.struct(*[c for c in checked.columns if c != "error"]))
    return checked.where(F.col("error").isNotNull()).select(
        F.coalesce(feed.cast("string"), F.lit("unknown")).alias("feed_id"),
        "error",
        F.lit("pipeline_failure").alias("error_type"),
        F.lit(stage).alias("stage"),
        body.alias("body"),
    )


def eligible(now: Column, c: LeaseConfig) -> Column:
    """Whether a feed may be leased: unclaimed, failing and due again, or active with a heartbeat that is too old."""
    stale = now - F.make_dt_interval(secs=F.lit(c.abandoned_s))
    return (
        (F.col("status") == "unclaimed")
        | ((F.col("status") == "failing") & (F.col("retry_after").isNull() | (F.col("retry_after") <= now)))
        | ((F.col("status") == "active") & (F.col("last_heartbeat") < stale))
    )


def priority() -> list[Column]:
    """The order that feeds are leased in; ties go by ``id``."""
    return [
        (F.col("status") == "unclaimed").desc(),
        F.col("retry_after").asc_nulls_first(),
        F.col("last_heartbeat").asc_nulls_first(),
        F.col("id").asc(),
    ]


def _leased(feeds: DataFrame, properties: DataFrame, worker: Column, now: Column) -> DataFrame:
    """The answer to a lease: new state, and what a worker resumes from, where ``feeds`` has it."""
    kept = [c for c in ("name", "source_type", "last_processed_filename") if c in feeds.columns]
    return feeds.select(
        "id",
        F.lit("active").alias("status"),
        worker.alias("worker_id"),
        now.alias("last_heartbeat"),
        (F.col("fencing_token") + 1).alias("fencing_token"),
        "failure_count",
        *kept,
    ).join(properties, "id", "left")


def lease(feeds: DataFrame, properties: DataFrame, worker: str, now: Column, c: LeaseConfig) -> DataFrame:
    """The feeds a worker gets: eligible ones by priority, up to its limit, with their new state, name, source type, last
    file and url.
    """
    top = feeds.where(eligible(now, c)).orderBy(*priority()).limit(c.limit)
    return _leased(top, properties, F.lit(worker), now)


def allocate(feeds: DataFrame, workers: DataFrame, properties: DataFrame, now: Column, c: LeaseConfig) -> DataFrame:
    """The feeds that each of many workers gets, as if they took their turns: ``workers`` (worker_id, capacity, turn) in
    the order of ``turn``, null first, ties by ``worker_id``; each takes up to its capacity of the eligible feeds that are
    left, by priority.  The rows are those of ``lease``.

    Feeds are numbered by priority over ranges, capacities become places by a running total over ranges, and both meet in
    a join on the place: no task holds all feeds or all workers, and no feed has two.  A capacity that is null or below 1
    gets nothing; feeds beyond all capacities and capacity beyond all feeds stay unused.
    """
    ranked = streams.numbered(feeds.where(eligible(now, c)), *priority(), name="_place")
    n = ranked.agg(F.count(F.lit(1)).alias("_feeds"))
    room = workers.select("worker_id", F.greatest(F.coalesce("capacity", F.lit(0)), F.lit(0)).cast("long").alias("_room"), "turn")
    placed = streams.running_total(room, "_room", "turn", "worker_id", name="_first")
    last = F.least(F.col("_first") + F.col("_room"), F.col("_feeds")) - 1
    places = (
        placed.crossJoin(F.broadcast(n))  # one row: the number of feeds
        .where(last >= F.col("_first"))
        .select("worker_id", F.explode(F.sequence(F.col("_first"), last)).alias("_place"))
    )
    taken = ranked.drop("worker_id").join(places, "_place")
    return _leased(taken, properties, F.col("worker_id"), now)


def apply_lease(feeds: DataFrame, leased: DataFrame) -> DataFrame:
    """The state table after a lease."""
    got = leased.select(
        "id", *[F.col(c).alias(f"_{c}") for c in ("worker_id", "last_heartbeat", "fencing_token")]
    )
    hit = F.col("_worker_id").isNotNull()
    return feeds.join(got, "id", "left").select(
        "id",
        F.when(hit, F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_worker_id")).otherwise(F.col("worker_id")).alias("worker_id"),
        F.when(hit, F.col("_last_heartbeat")).otherwise(F.col("last_heartbeat")).alias("last_heartbeat"),
        F.when(hit, F.col("_fencing_token")).otherwise(F.col("fencing_token")).alias("fencing_token"),
        F.when(~hit, F.col("retry_after")).alias("retry_after"),
        "failure_count",
    )


def fenced(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (id, worker_id, fencing_token) with ``done``: whether it still holds the feed."""
    own = feeds.select("id", "worker_id", "fencing_token", F.lit(True).alias("_own"))
    return requests.join(own, ["id", "worker_id", "fencing_token"], "left").withColumn(
        "done", F.coalesce("_own", F.lit(False))
    ).drop("_own")


def heartbeats(feeds: DataFrame, ids: DataFrame, worker: str) -> DataFrame:
    """Per asked id that exists: its state and whether the worker's lease was renewed (active and its own)."""
    renewed = (F.col("status") == "active") & F.coalesce(F.col("worker_id") == worker, F.lit(False))
    return feeds.join(ids, "id", "left_semi").select("id", "status", "worker_id", renewed.alias("renewed"))


def report_failure(feeds: DataFrame, failed: DataFrame, now: Column, c: LeaseConfig, jitter: Column) -> DataFrame:
    """State of the failed feeds: counted, released, quarantined at the threshold or given a later retry."""
    n = F.col("failure_count") + 1
    out = n >= c.threshold
    wait = F.least(F.lit(float(c.cap_s)), F.lit(float(c.base_s)) * F.pow(F.lit(2.0), F.col("failure_count"))) + jitter
    return feeds.join(failed, "id", "left_semi").select(
        "id",
        F.when(out, F.lit("quarantined")).otherwise(F.lit("failing")).alias("status"),
        n.alias("failure_count"),
        F.lit(None).cast("string").alias("worker_id"),
        F.when(~out, wait).alias("retry_in_s"),
        F.when(~out, now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("retry_after"),
    )


def release(feeds: DataFrame, worker: str) -> DataFrame:
    """The active feeds of a worker, unclaimed again."""
    own = (F.col("worker_id") == worker) & (F.col("status") == "active")
    return feeds.where(own).select("id", F.lit("unclaimed").alias("status"), F.lit(None).cast("string").alias("worker_id"))


def tolerance_first(left: DataFrame, right: DataFrame, key: str, a: str, b: str, within: float, order: str) -> DataFrame:
    """Left join on ``key`` and ``abs(a - b) < within``: the first match in the order of ``order`` and ``b``, as
    ``found``; null without one.

    Both sides are cut into cells of the tolerance's width, so the join is an equality on (key, cell), followed
    by one aggregate over the left rows.  Nulls in any column, and repeated left rows, stay as they are.
    """
    cell = F.floor(F.col(b) / within)
    near = right.select(
        F.struct(*[c for c in right.columns if c != key]).alias("_found"),
        F.struct(order, b).alias("_order"),
        F.col(key).alias("_key"),
        F.col(b).alias("_b"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"),
    )
    own = left.select(
        F.struct(*left.columns).alias("_row"),
        F.monotonically_increasing_id().alias("_id"),
        F.floor(F.col(a) / within).alias("_at"),
    )
    hit = F.abs(F.col(f"_row.{a}") - F.col("_b")) < within
    joined = own.join(near, (F.col(f"_row.{key}") == F.col("_key")) & (F.col("_at") == F.col("_cell")), "left")
    first = F.min_by("_found", F.when(hit, F.col("_order"))).alias("found")
    return joined.groupBy("_id").agg(F.first("_row").alias("_row"), first).select("_row.*", "found")


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``left`` with ``value`` of the row of ``right`` with its key as text, or ``default``; ``unmatched`` tells
    whether there is such a row.  Of several rows with a key the greatest text counts, so ``left`` keeps its rows; a null
    key matches none.
    """
    side = right.groupBy(key).agg(F.max(F.col(value).cast("string")).alias("_value"), F.lit(True).alias("_hit"))
    return left.join(side, key, "left").select(
        *left.columns, F.coalesce("_value", default).alias(value), F.col("_hit").isNull().alias("unmatched")
    )


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key no row of ``done`` has."""
    return wanted.join(done.where(F.col(key).isNotNull()), key, "left_anti")


def pending_names(wanted: DataFrame, done: DataFrame, path: str, name: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``wanted`` whose basename stands in no ``name`` of ``done``.

    ``tokens`` gives all parts of a name in which a basename may stand, so that the search is an equality join:
    names are cut once, and no row of one side meets all of the other.
    """
    held = done.select(F.explode(tokens(F.col(name))).alias("_base")).distinct()
    return wanted.join(held, C.basename(F.col(path)) == F.col("_base"), "left_anti")


def pivot_counts(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row a key, one count a kind, in one pass with partial sums."""
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def tally(df: DataFrame, **checks: Column) -> DataFrame:
    """One row: how many rows there are, and how many pass each check."""
    return df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(c).alias(n) for n, c in checks.items()])


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every line that is not blank."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(C.not_blank(F.col("line")))


def large_enough(files: DataFrame, size: str, least: int, strict: bool = False) -> DataFrame:
    """The rows of at least that size, or beyond it."""
    return files.where(F.col(size) > least if strict else F.col(size) >= least)


def lost(feeds: DataFrame, worker: str) -> DataFrame:
    """Ids of the active feeds whose lease the worker could not renew."""
    held = feeds.where("status = 'active'").select("id")
    return held.join(heartbeats(feeds, held, worker).where("renewed"), "id", "left_anti")


def _fenced_update(feeds: DataFrame, requests: DataFrame, changes: dict[str, Column], *carry: str) -> DataFrame:
    """The state table with ``changes`` on the feeds whose (id, worker_id, fencing_token) a request has, and
    ``updated``, which tells them.  A repeated request counts once.
    """
    side = requests.groupBy("id", "worker_id", "fencing_token").agg(F.lit(True).alias("_hit"), *[F.max(c).alias(f"_{c}") for c in carry])
    joined = feeds.join(side, ["id", "worker_id", "fencing_token"], "left").withColumn("updated", F.col("_hit").isNotNull())
    out = [F.when(F.col("updated"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in feeds.columns]
    return joined.select(*out, "updated")


def progress(feeds: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The state table after fenced progress reports (id, worker_id, fencing_token, last_processed_filename)."""
    changes = {
        "last_processed_filename": F.col("_last_processed_filename"), "last_heartbeat": now,
        "failure_count": F.lit(0).cast(feeds.schema["failure_count"].dataType),
    }
    return _fenced_update(feeds, requests, changes, "last_processed_filename")


def fenced_release(feeds: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The state table after fenced releases (id, worker_id, fencing_token): unclaimed, without a worker."""
    changes = {"status": F.lit("unclaimed"), "worker_id": F.lit(None).cast("string"), "last_heartbeat": now}
    return _fenced_update(feeds, requests, changes)


def affected(updated: DataFrame) -> DataFrame:
    """One row: how many rows an update changed, of how many."""
    return tally(updated, updated=F.col("updated")).withColumnRenamed("checked", "n_rows")


def changed_rules(rules: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Rules with the non-null fields of ``changes`` (by rule_id) put in; ``updated_at`` moves with them."""
    names = [c for c in rules.columns if c not in ("rule_id", "updated_at")]
    new = changes.select("rule_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c in names])
    joined = rules.join(new, "rule_id", "left")
    out = [
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in names
    ]
    return joined.select("rule_id", *out, F.when(F.col("_hit"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks (seeds, create-only writes)."""
    return table.unionByName(rows.join(table, key, "left_anti"))


def violations(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, rule) for every broken constraint of the feed table."""
    names = feeds.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("_same"))
    known = sources.select(F.col("slug").alias("source_type"), F.lit(True).alias("_known")).distinct()
    bad = feeds.join(names, "name", "left").join(known, "source_type", "left")
    checks = {
        "null name": F.col("name").isNull(),
        "name not unique": F.col("name").isNotNull() & (F.col("_same") > 1),
        "unknown source type": F.col("_known").isNull(),
    }
    return bad.select(
        "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule")
    )


# The states of a feed.
STATUSES = ("unclaimed", "active", "failing", "quarantined", "deactivated")


def all_violations(feeds: DataFrame, sources: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, rule) for every broken constraint of the feed table and of its ``properties`` (feed_id, stream_url).

    Keys are counted in partial sums, null ones only marked, so no key of many rows fills a task.  A null source type breaks
    its own rule, not that of known ones; a property row of no feed is listed under its own id.
    """
    ids = feeds.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_ids"))
    own = feeds.join(ids.where("_ids > 1"), "id", "left")
    checks = {
        "null id": F.col("id").isNull(),
        "id not unique": F.col("_ids").isNotNull(),
        "null source type": F.col("source_type").isNull(),
        "null status": F.col("status").isNull(),
        "unknown status": ~F.col("status").isin(*STATUSES),
        "null failure count": F.col("failure_count").isNull(),
        "null creation time": F.col("created_at").isNull(),
    }
    rules = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    known = violations(feeds.where(F.col("source_type").isNotNull()), sources).where("rule = 'unknown source type'")
    names = violations(feeds, sources).where("rule <> 'unknown source type'")
    one = feeds.select(F.col("id").alias("feed_id")).where("feed_id IS NOT NULL").distinct()
    orphans = properties.join(one, "feed_id", "left_anti").select(F.col("feed_id").alias("id"), F.lit("properties of no feed").alias("rule"))
    urls = properties.where(F.col("stream_url").isNull()).select(F.col("feed_id").alias("id"), F.lit("null stream url").alias("rule"))
    return own.select("id", F.explode(rules).alias("rule")).unionByName(known).unionByName(names).unionByName(orphans).unionByName(urls)


# Fixed value: the fields of a chunk message.
CHUNK = "start_timestamp struct<seconds: long, nanos: int>, gcs_uri string, session_id string"


def chunk_events(messages: DataFrame, body: str = "body") -> DataFrame:
    """Chunk messages (``body``: JSON) with their fields, ``event_time_s`` and ``error``: the first that holds of a body that
    can't be read, no start time, no uri, no session.  A null body can't be read; empty texts are missing.
    """
    schema = f"{CHUNK}, _broken string"
    read = F.from_json(F.coalesce(F.col(body), F.lit("")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = messages.withColumn("_chunk", read).select(*messages.columns, "_chunk.*")
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unread = F.col("_broken").isNotNull() | (F.trim(F.coalesce(F.col(body), F.lit(""))) == "")
    checked = with_error(
        rows,
        [
            (unread, "failed to parse chunk"),
            (F.col("start_timestamp").isNull(), "missing start_timestamp"),
            (missing("gcs_uri"), "missing gcs_uri"),
            (missing("session_id"), "missing session_id"),
        ],
    )
    at = F.coalesce("start_timestamp.seconds", F.lit(0)) + F.coalesce("start_timestamp.nanos", F.lit(0)) / 1e9
    return checked.withColumn("event_time_s", F.when(F.col("error").isNull(), at)).drop("_broken", "start_timestamp")


#: Fields of an evaluated payload that are never unset: what isn't known is zero.
ZEROED = ("start_ms", "end_ms", "start_audio_offset_ms", "end_audio_offset_ms")


def evaluated_payload(evaluated: DataFrame) -> DataFrame:
    """Evaluated transcripts as payloads: as they are, but unset times and offsets are zero, unset flags false and unset
    decisions none, so that a reader can't tell a value that was never set from zero.
    """
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(evaluated.schema[c].dataType)) for c in ZEROED if c in evaluated.columns}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("missing_prior_context", "missing_post_context") if c in evaluated.columns}
    none = {"decisions": F.coalesce("decisions", F.array().cast("array<string>"))} if "decisions" in evaluated.columns else {}
    return evaluated.withColumns(zero | flags | none)
