"""The registered queries: each operator on the given tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.config import LeaseConfig, StitchConfig
from skerry.functions import columns as C
from skerry.functions import signal
from skerry.operators import nested, quantiles, rules, streams, tables, words
from skerry.operators.tables import Rule
from skerry.sources import files, remote

NOW = "2024-06-01 00:00:00"
HOUR = 3_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# rules

REGEX_RULES = [
    Rule("articles", "regex", expression=r"\b(the|and)\b"),
    Rule("german", "regex", expression=r"\b(und|der)\b"),
    tables.BUILT_IN,
    Rule("sleeping", "regex", expression=".", is_active=False),
]
_EDGE = r"(^|[^\p{L}\p{N}_])"


def _regex(words: str) -> str:
    return f"regexp_matches(t, '(?i){_EDGE}({words})([^\\p{{L}}\\p{{N}}_]|$)')"


_DECISIONS = (
    "concat_ws(',', CASE WHEN " + _regex("the|and") + " THEN 'articles' END, CASE WHEN " + _regex("und|der")
    + " THEN 'german' END, CASE WHEN " + _regex("fire|burn|evacuation|spreading") + " THEN 'basic_fire_terms' END)"
)
# not blank: anything but white space
_SAYS = r"regexp_matches({t}, '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]')"
_TEXTS = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(f"SELECT doc_id, {_DECISIONS} AS decisions FROM {_TEXTS} WHERE {_DECISIONS} <> ''")
def rule_eval_regex(spark, sf_dir):
    out = tables.flagged(tables.evaluate(table(spark, sf_dir, "documents"), REGEX_RULES))
    return out.select("doc_id", F.array_join("decisions", ",").alias("decisions"))


@query(
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'ung') THEN 'any' END,
       CASE WHEN contains(text, 'The') THEN 'case' END) AS decisions
       FROM conversations WHERE text IS NOT NULL AND (contains(lower(text), 'the') OR contains(lower(text), 'ung'))"""
)
def rule_eval_keyword_any(spark, sf_dir):
    rules = [
        Rule("any", "keyword", ("THE", "ung")),
        Rule("case", "keyword", ("The",), case_sensitive=True),
        Rule("none", "keyword", ()),
    ]
    out = tables.flagged(tables.evaluate(table(spark, sf_dir, "conversations"), rules))
    return out.select("conv_id", "turn", F.array_join("decisions", ",").alias("decisions"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(t), 'the') AND contains(lower(t), 'and') AND contains(lower(t), 'was') THEN 'all' END, 'empty') AS decisions
       FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE """
    + _SAYS.format(t="t")
)
def rule_eval_keyword_all(spark, sf_dir):
    rules = [Rule("all", "keyword", ("the", "and", "was"), "ALL"), Rule("empty", "keyword", (), "ALL")]
    out = tables.flagged(tables.evaluate(table(spark, sf_dir, "documents"), rules))
    return out.select("doc_id", F.array_join("decisions", ",").alias("decisions"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(t), 'the') THEN 'a' END, CASE WHEN contains(lower(t), 'ung') THEN 'b' END,
       CASE WHEN contains(lower(t), 'the') AND contains(lower(t), 'ung') THEN 'both' END) AS decisions
       FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE contains(lower(t), 'the') OR contains(lower(t), 'ung')"""
)
def rule_group_extension(spark, sf_dir):
    rules = [
        Rule("a", "keyword", ("the",)),
        Rule("b", "keyword", ("ung",)),
        Rule("both", "group", operator="ALL", children=("a", "b")),
    ]
    out = tables.flagged(tables.evaluate(table(spark, sf_dir, "documents"), rules, groups=True))
    return out.select("doc_id", F.array_join("decisions", ",").alias("decisions"))


@query(
    f"""SELECT rule_id, count(*) AS n_texts FROM (SELECT unnest(string_split({_DECISIONS}, ',')) AS rule_id
        FROM {_TEXTS}) WHERE rule_id <> '' GROUP BY rule_id ORDER BY n_texts DESC, rule_id"""
)
def rule_hits_summary(spark, sf_dir):
    out = tables.evaluate(table(spark, sf_dir, "documents"), REGEX_RULES)
    return (
        out.select(F.explode("decisions").alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n_texts"))
        .orderBy(F.desc("n_texts"), "rule_id")
    )


@query(
    """SELECT conv_id, turn, coalesce(CAST(nullif(turn, 0) AS VARCHAR), 'unset') AS start_ms, coalesce(CASE WHEN role = 'user' THEN turn END, 0) AS offset_ms
       FROM conversations WHERE contains(lower(text), 'the')"""
)
def notify_projection(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = tables.flagged(tables.evaluate(turns, [Rule("the", "keyword", ("the",))]))
    return out.select(
        "conv_id",
        "turn",
        F.coalesce(F.nullif("turn", F.lit(0)).cast("string"), F.lit("unset")).alias("start_ms"),
        F.coalesce(F.when(F.col("role") == "user", F.col("turn")), F.lit(0)).alias("offset_ms"),
    )


# messages

_CHECKED = """SELECT event_id, user_id, event_type, props, CASE WHEN k IS NULL THEN 'missing k' WHEN k < 10 THEN 'k too small'
  WHEN value IS NULL OR value < 5 THEN 'value too small' END AS error
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _checked(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return tables.with_error(
        events,
        [
            (F.col("k").isNull(), "missing k"),
            (F.col("k") < 10, "k too small"),
            (F.col("value") < 5, "value too small"),
        ],
    )


@query(f"SELECT event_id, coalesce(error, 'none') AS error FROM ({_CHECKED})")
def parse_dlq_split(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_id", F.coalesce("error", F.lit("none")).alias("error"))


@query(
    f"""SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS feed_id, error, 'pipeline_failure' AS error_type, 'parse' AS stage,
               CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM ({_CHECKED}) WHERE error IS NOT NULL
        UNION ALL SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown'), 'no purchase value', 'pipeline_failure', 'value',
               CAST(event_id AS VARCHAR), event_type, props FROM events WHERE event_type = 'purchase' AND value < 1"""
)
def dlq_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    broken = (F.col("event_type") == "purchase") & (F.col("value") < 1)
    second = tables.with_error(events, [(broken, "no purchase value")])
    one = tables.dead_letters(_checked(spark, sf_dir), F.col("user_id"), "parse")
    both = one.unionByName(tables.dead_letters(second, F.col("user_id"), "value"))
    inside = [F.get_json_object("body", f"$.{c}").alias(c) for c in ("event_id", "event_type", "props")]
    return both.select("*", *inside).drop("body")


@query("SELECT event_id, epoch_us(ts) // 1000 AS event_ts_ms, (epoch_us(ts) // 1000) // 15000 * 15000 AS chunk_ms FROM events")
def event_time_ms(spark, sf_dir):
    ms = C.to_ms(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", ms.alias("event_ts_ms"), (F.floor(ms / 15000) * 15000).cast("long").alias("chunk_ms")
    )


_MS = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", C.to_ms(F.col("ts")).alias("ms")
    )


@query(
    f"""SELECT user_id, event_id, n, a + n * 15000 AS chunk_start_ms FROM (SELECT user_id, event_id,
        row_number() OVER w - 1 AS n, min(ms) OVER (PARTITION BY user_id) AS a FROM {_MS} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))"""
)
def chunk_timeline(spark, sf_dir):
    events = _events(spark, sf_dir)
    rows = streams.chunk_starts(events.repartition(streams.tasks_for(events), "user_id"), "user_id", "ms", ["ms", "event_id"], 15000)
    return rows.select("user_id", "event_id", "n", "chunk_start_ms")


@query(
    f"""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
        || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS transmission_id FROM (SELECT event_id,
        sha1(unhex('{C.NAMESPACE_OID}') || encode(user_id || '_' || ms || '_' || (ms + 15000))) AS h FROM {_MS})"""
)
def transmission_uuid5(spark, sf_dir):
    name = F.concat_ws("_", *[x.cast("string") for x in (F.col("user_id"), F.col("ms"), F.col("ms") + 15000)])
    return _events(spark, sf_dir).select("event_id", C.uuid5(name).alias("transmission_id"))


@query(
    """SELECT o_orderkey, 'icecast/' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/token-' || o_orderkey % 5 END || '/' ||
       strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || o_orderkey || '.flac' AS staged,
       'stitched/' || o_custkey || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.flac' AS stitched,
       'bucket-' || o_custkey % 7 AS bucket, 'raw/' || o_orderkey AS object, CAST(o_orderkey AS VARCHAR) AS base FROM orders"""
)
def storage_paths(spark, sf_dir):
    token = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5)
    uri = F.concat(F.lit("gs://bucket-"), (F.col("o_custkey") % 7).cast("string"), F.lit("/raw/"), F.col("o_orderkey").cast("string"))
    feed, at, key = F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        C.staged_path(F.lit("icecast"), feed, token, at, key).alias("staged"),
        C.stitched_path(feed, at).alias("stitched"),
        C.gs_bucket(uri).alias("bucket"),
        C.gs_object(uri).alias("object"),
        C.basename(uri).alias("base"),
    )


# sessions and intervals


@query(
    f"""SELECT user_id, CAST(session AS BIGINT) AS session, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_rows FROM (
        SELECT user_id, ms, sum(f) OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS session FROM (
        SELECT user_id, ms, event_id, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < {6 * HOUR} THEN 0 ELSE 1 END AS f FROM {_MS}))
        GROUP BY user_id, session"""
)
def gap_sessions(spark, sf_dir):
    rows = streams.gap_sessions(_events(spark, sf_dir).select("user_id", "ms", "event_id"), "user_id", "ms", 6 * HOUR)
    return rows.groupBy("user_id", "session").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS k FROM {_MS}),
        s(user_id, k, ms, start, session) AS (
          SELECT user_id, k, ms, ms, CAST(0 AS BIGINT) FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.k, e.ms, CASE WHEN e.ms - s.ms >= {12 * HOUR} OR e.ms - s.start >= {24 * HOUR} THEN e.ms ELSE s.start END,
            s.session + CASE WHEN e.ms - s.ms >= {12 * HOUR} OR e.ms - s.start >= {24 * HOUR} THEN 1 ELSE 0 END
          FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
        SELECT user_id, session, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_rows FROM s GROUP BY user_id, session"""
)
def gap_max_sessions(spark, sf_dir):
    return streams.gap_max_sessions(_events(spark, sf_dir), "user_id", "ms", 12 * HOUR, 24 * HOUR)


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, ms, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS k FROM {_MS}),
        s(user_id, event_type, k, event_id, ms, until, first) AS (
          SELECT user_id, event_type, k, event_id, ms, ms + {24 * HOUR}, true FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.event_type, e.k, e.event_id, e.ms, CASE WHEN e.ms < s.until THEN s.until ELSE e.ms + {24 * HOUR} END, e.ms >= s.until
          FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.k = s.k + 1)
        SELECT user_id, event_type, ms, event_id FROM s WHERE first"""
)
def ttl_dedup(spark, sf_dir):
    return streams.ttl_first(_events(spark, sf_dir), ["user_id", "event_type"], "ms", 24 * HOUR, "event_id")


@query(f"SELECT user_id, event_type, min(ms) AS ms FROM {_MS} GROUP BY user_id, event_type")
def watermark_dedup_ids(spark, sf_dir):
    return streams.first_of(_events(spark, sf_dir), ["user_id", "event_type"], "ms")


def _arrivals(spark, sf_dir):
    w = Window.partitionBy("user_id")
    slot = F.row_number().over(w.orderBy("ms", "event_id")) - 1
    return (
        _events(spark, sf_dir)
        .withColumn("event_ts_ms", (slot * 15000).cast("long"))
        .withColumn("_moved", slot + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0))
        .withColumn("seq", F.row_number().over(w.orderBy("_moved", "event_id")).cast("long"))
        .select(
            F.col("user_id").alias("feed_id"),
            F.lit("s").alias("session_id"),
            F.concat(F.lit("gs://b/"), F.col("event_id").cast("string")).alias("gcs_uri"),
            "event_ts_ms",
            (F.col("seq") * 15000).alias("arrival_ts_ms"),
            "seq",
        )
    )


_CHUNK = "STRUCT(ts BIGINT, uri VARCHAR)"
# waiting chunks in order, each let out if it is near what is expected by then
_DRAIN = f"""list_reduce(list_prepend({{{{'ex': {{ex}}, 'out': CAST([] AS {_CHUNK}[]), 'kept': CAST([] AS {_CHUNK}[])}}}},
  list_transform(list_sort({{waiting}}), lambda w: {{{{'ex': w.ts, 'out': [w], 'kept': CAST([] AS {_CHUNK}[])}}}})),
  lambda s, x: CASE WHEN abs(x.ex - s.ex) <= 500 THEN {{{{'ex': x.ex + 15000, 'out': list_concat(s.out, x.out), 'kept': s.kept}}}}
                    ELSE {{{{'ex': s.ex, 'out': s.out, 'kept': list_concat(s.kept, x.out)}}}} END)"""
_NAMED = "list_transform({chunks}, lambda w: {{'ts': w.ts, 'uri': w.uri, 'kind': '{kind}'}})"


@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS slot FROM {_MS}),
a AS (
  SELECT user_id AS feed_id, slot * 15000 AS ts, 'gs://b/' || event_id AS uri,
         row_number() OVER (PARTITION BY user_id ORDER BY slot + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END, event_id) AS seq
  FROM e),
r(feed_id, seq, ex, waiting, due, o) AS (
  SELECT DISTINCT feed_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS {_CHUNK}[]), CAST(NULL AS BIGINT),
         CAST([] AS STRUCT(ts BIGINT, uri VARCHAR, kind VARCHAR)[]) FROM a
  UNION ALL
  SELECT feed_id, seq, ex3, waiting3, CASE WHEN len(waiting3) = 0 THEN NULL ELSE coalesce(due1, seq * 15000 + 15000) END,
         list_concat(gap_out, CASE WHEN early THEN [] ELSE list_concat(
           [{{'ts': ts, 'uri': uri, 'kind': CASE WHEN late THEN 'late' ELSE 'ordered' END}}],
           CASE WHEN late THEN [] ELSE {_NAMED.format(chunks="next.out", kind="drained")} END) END)
  FROM (
    SELECT *, CASE WHEN early THEN list_append(waiting1, {{'ts': ts, 'uri': uri}}) WHEN late THEN waiting1 ELSE next.kept END AS waiting3,
           CASE WHEN early OR late THEN ex2 ELSE next.ex END AS ex3
    FROM (
      SELECT *, ts - ex2 > 500 AS early, ts - ex2 < -500 AS late, {_DRAIN.format(ex="ts + 15000", waiting="waiting1")} AS next
      FROM (
        SELECT *, coalesce(ex1, ts) AS ex2 FROM (
          SELECT *, CASE WHEN fired THEN NULL ELSE due END AS due1,
                 CASE WHEN fired AND len(waiting) > 0 THEN first.ex ELSE ex END AS ex1,
                 CASE WHEN fired THEN first.kept ELSE waiting END AS waiting1,
                 CASE WHEN fired THEN {_NAMED.format(chunks="first.out", kind="gap")} ELSE [] END AS gap_out
          FROM (
            SELECT r.feed_id, a.seq, a.ts, a.uri, r.ex, r.waiting, r.due, coalesce(a.seq * 15000 >= r.due, false) AS fired,
                   {_DRAIN.format(ex="coalesce(list_min(r.waiting).ts, 0)", waiting="r.waiting")} AS first
            FROM r JOIN a ON a.feed_id = r.feed_id AND a.seq = r.seq + 1)))))),
z AS (
  SELECT feed_id, seq, o FROM r
  UNION ALL
  SELECT feed_id, seq + 1, {_NAMED.format(chunks=_DRAIN.format(ex="coalesce(list_min(waiting).ts, 0)", waiting="waiting") + ".out", kind="gap")}
  FROM (SELECT *, seq = max(seq) OVER (PARTITION BY feed_id) AS last FROM r) WHERE last AND due IS NOT NULL)
SELECT feed_id, c.ts AS event_ts_ms, c.uri AS gcs_uri, c.kind AS kind, row_number() OVER (PARTITION BY feed_id ORDER BY seq, i) - 1 AS place
FROM (SELECT feed_id, seq, unnest(o) AS c, generate_subscripts(o, 1) AS i FROM z)
""")
def reorder_replay(spark, sf_dir):
    return streams.reorder(_arrivals(spark, sf_dir))


_STITCH = f"""
WITH RECURSIVE c AS (
  SELECT user_id AS feed_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM {_MS}),
d AS (
  SELECT feed_id, k, 'gs://b/' || event_id AS uri, (k - 1 + k // 9) * 15000 AS f,
         CASE WHEN event_id % 5 < 4 THEN event_id % 4000 END AS b, CASE WHEN event_id % 5 < 4 THEN 9000 + event_id % 6000 END AS e
  FROM c),
r(feed_id, k, tx, bs, bd, le, uris, prior, ex, so, au, o) AS (
  SELECT DISTINCT feed_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
         '', false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT),
         CAST(NULL AS STRUCT(uris VARCHAR, a BIGINT, z BIGINT, pre BOOLEAN, post BOOLEAN, off BIGINT, why VARCHAR, n BIGINT)) FROM d
  UNION ALL
  SELECT feed_id, k + 1, CASE WHEN b IS NULL THEN tx2 ELSE coalesce(tx2, f + b) END,
         CASE WHEN b IS NOT NULL AND tx2 IS NULL THEN f + lead_in ELSE bs END, bd2 + more, CASE WHEN b IS NULL THEN le ELSE f + e END,
         CASE WHEN b IS NULL AND tx2 IS NULL THEN uris2 WHEN uris2 = '' THEN uri ELSE uris2 || ',' || uri END,
         prior2 AND NOT (b IS NOT NULL AND tx2 IS NULL AND b > 0), f + 15000,
         CASE WHEN b IS NOT NULL AND tx2 IS NULL THEN lead_in ELSE so END, au2 + more, o2
  FROM (
    SELECT *, CASE WHEN b IS NOT NULL THEN greatest(0, least(15000, e + 1000) - CASE WHEN tx2 IS NULL THEN lead_in ELSE 0 END)
                   WHEN tx2 IS NOT NULL THEN tail ELSE 0 END AS more
    FROM (
      SELECT *, CASE WHEN stop THEN NULL ELSE tx1 END AS tx2, greatest(0, b - 1000) AS lead_in,
             CASE WHEN lost OR stop THEN 0 ELSE bd END AS bd2, CASE WHEN lost OR stop THEN '' ELSE uris END AS uris2,
             CASE WHEN lost OR done THEN 0 ELSE au END AS au2, CASE WHEN done THEN b IS NOT NULL AND long ELSE prior OR missing END AS prior2,
             CASE WHEN (lost OR done) AND au + CASE WHEN done THEN tail ELSE 0 END > 0 THEN
               {{'uris': uris, 'a': bs, 'z': bs + bd + CASE WHEN done THEN tail ELSE 0 END, 'pre': prior, 'post': lost OR long, 'off': so,
                 'why': CASE WHEN lost THEN 'missing chunk' ELSE CASE WHEN gap THEN 'gap' ELSE 'longest duration' END || CASE WHEN b IS NULL THEN ' in silence' ELSE '' END END,
                 'n': au + CASE WHEN done THEN tail ELSE 0 END}} END AS o2
      FROM (
        SELECT *, gap OR long AS stop, (gap OR long) AND tx1 IS NOT NULL AS done FROM (
          SELECT *, le IS NOT NULL AND f + coalesce(b, 0) - le >= 3000 AS gap,
                 tx1 IS NOT NULL AND f + coalesce(b, 15000) - tx1 >= 60000 AS long,
                 greatest(0, least(coalesce(b, 15000), le + 1000 - f)) AS tail
          FROM (
            SELECT *, coalesce(f > ex, false) AS missing, coalesce(f > ex, false) AND tx IS NOT NULL AS lost,
                   CASE WHEN coalesce(f > ex, false) THEN NULL ELSE tx END AS tx1
            FROM (SELECT r.*, d.uri, d.f, d.b, d.e FROM r JOIN d ON d.feed_id = r.feed_id AND d.k = r.k + 1)))))))
SELECT feed_id, o.uris AS contributing_audio_uris, o.a AS start_ms, o.z AS end_ms, o.pre AS missing_prior_context,
       o.post AS missing_post_context, o.off AS start_audio_offset_ms, o.why AS reason, o.n AS audio_ms FROM r WHERE o IS NOT NULL
UNION ALL
SELECT feed_id, uris, tx, le, prior, true, so, 'stale', au
FROM (SELECT *, k = max(k) OVER (PARTITION BY feed_id) AS last FROM r) WHERE last AND tx IS NOT NULL AND au > 0
"""


@query(_STITCH)
def stitch_transmissions(spark, sf_dir):
    speech = F.when(
        F.col("event_id") % 5 < 4,
        F.array(F.struct((F.col("event_id") % 4000).alias("start_ms"), (9000 + F.col("event_id") % 6000).alias("end_ms"))),
    )
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    chunks = _events(spark, sf_dir).select(
        F.col("user_id").alias("feed_id"),
        F.concat(F.lit("gs://b/"), F.col("event_id").cast("string")).alias("gcs_uri"),
        ((F.row_number().over(w) - 1 + F.floor(F.row_number().over(w) / 9)) * 15000).cast("long").alias("start_ms"),
        F.lit(15000).cast("long").alias("duration_ms"),
        speech.alias("speech_segments"),
        F.row_number().over(w).cast("long").alias("place"),
    )
    found = streams.stitch(chunks, StitchConfig(gap_ms=3000, max_ms=60_000))
    return found.withColumn("contributing_audio_uris", F.array_join("contributing_audio_uris", ","))


_ON = f"(SELECT *, value > 50 AS hot FROM {_MS})"


def _hot(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("hot", F.col("value") > 50)


@query(
    f"""SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_rows FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - row_number() OVER (PARTITION BY user_id, hot ORDER BY ms, event_id) AS g FROM {_ON})
        WHERE hot GROUP BY user_id, g"""
)
def runlength_intervals(spark, sf_dir):
    return streams.run_intervals(_hot(spark, sf_dir), "user_id", "ms", "hot", ("event_id",))


@query(
    f"""SELECT event_id, sum(CAST(hot AS INT)) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 3 AS "on" FROM {_ON}"""
)
def majority_debounce(spark, sf_dir):
    return streams.majority(_hot(spark, sf_dir), "user_id", ["ms", "event_id"], "hot", 2).select("event_id", "on")


@query(
    f"SELECT event_id, bool_or(hot) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS held FROM {_ON}"
)
def forward_hangover(spark, sf_dir):
    return streams.hangover(_hot(spark, sf_dir), "user_id", ["ms", "event_id"], "hot", 3).select("event_id", "held")


@query("SELECT user_id, round(quantile_cont(value, 0.1), 6) AS floor_p10, count(value) AS n_rows FROM events GROUP BY user_id")
def noise_floor_p10(spark, sf_dir):
    found = quantiles.exact_quantile(table(spark, sf_dir, "events"), ["user_id"], "value", 0.1, "floor_p10")
    return found.select("user_id", F.round("floor_p10", 6).alias("floor_p10"), F.col("n").alias("n_rows"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 5) AS rms,
       CAST(len(list_filter(embedding, lambda x: x >= 0.05)) AS BIGINT) * 16 AS speech_ms FROM embeddings"""
)
def vector_rms(spark, sf_dir):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    total = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.sqrt(total / F.size("embedding")), 5).alias("rms"),
        C.frames_ms(F.col("embedding"), 0.05, 16).alias("speech_ms"),
    )


# arrays of 0 to 64 values; an index beyond the ends is reflected there as often as it takes
@query("""
WITH e AS (SELECT vec_id, embedding[1:CAST(vec_id % 65 AS INT)] AS x, CAST(vec_id % 65 AS INT) AS n FROM embeddings WHERE vec_id % 65 > 0),
p AS (
  SELECT vec_id, n, list_transform(list_transform(range(-8, n + 8), lambda i: ((i % greatest(2 * n - 2, 1)) + greatest(2 * n - 2, 1)) % greatest(2 * n - 2, 1)),
         lambda m: CAST(x[CAST(least(m, greatest(2 * n - 2, 1) - m) AS INT) + 1] AS DOUBLE) * x[CAST(least(m, greatest(2 * n - 2, 1) - m) AS INT) + 1]) AS y FROM e)
SELECT vec_id, CAST(f AS INT) AS frame, round(sqrt(list_sum(y[f * 4 + 1:f * 4 + 16]) / 16), 6) AS rms
FROM (SELECT vec_id, y, unnest(range(0, n // 4 + 1)) AS f FROM p)
""")
def framed_rms(spark, sf_dir):
    arrays = table(spark, sf_dir, "embeddings").withColumn("x", F.slice("embedding", 1, (F.col("vec_id") % 65).cast("int")))
    rows = signal.framed(arrays, "vec_id", "x", lambda x: signal.rms(x, 4, 16))
    return rows.select("vec_id", "frame", F.round("value", 6).alias("rms"))


@query("""
WITH p AS (SELECT vec_id, list_transform(list_concat(list_concat(list_transform(range(0, 8), lambda i: 0.0), list_transform(embedding, lambda v: CAST(v AS DOUBLE))),
                  list_transform(range(0, 8 + (len(embedding) * 3) % 4), lambda i: 0.0)) , lambda v: v) AS x FROM embeddings),
f AS (SELECT vec_id, unnest(range(0, (len(x) - 16) // 4 + 1)) AS f, x FROM p),
s AS (
  SELECT vec_id, f, list_transform(range(0, 9), lambda k: greatest(1e-10, (
    pow(list_sum(list_transform(range(0, 16), lambda n: x[f * 4 + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * k * n / 16))), 2)
    + pow(list_sum(list_transform(range(0, 16), lambda n: x[f * 4 + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * k * n / 16))), 2)) / 64)) AS spectrum
  FROM f)
SELECT vec_id, CAST(f AS INT) AS frame, round(exp(list_avg(list_transform(spectrum, lambda v: ln(v)))) / list_avg(spectrum), 5) AS flatness FROM s
""")
def vector_flatness(spark, sf_dir):
    rows = signal.framed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda x: signal.flatness(x, 16, 16, 4))
    return rows.select("vec_id", "frame", F.round("value", 5).alias("flatness"))


# leases

_FEEDS = f"""(SELECT s_suppkey AS id, s_name AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'unclaimed' WHEN 1 THEN 'active' WHEN 2 THEN 'failing' WHEN 3 THEN 'quarantined' ELSE 'deactivated' END AS status,
  CASE WHEN s_suppkey % 5 = 1 THEN 'w' || s_suppkey % 3 END AS worker_id,
  CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '{NOW}' - to_seconds(s_suppkey % 200) END AS last_heartbeat,
  CASE WHEN s_suppkey % 5 = 2 AND s_suppkey % 4 > 0 THEN TIMESTAMP '{NOW}' + to_seconds((s_suppkey % 4 - 2) * 60) END AS retry_after,
  s_suppkey % 7 AS failure_count, s_suppkey % 4 AS fencing_token, 'type' || s_nationkey % 3 AS source_type,
  CASE WHEN s_suppkey % 3 > 0 THEN 'f' || s_suppkey || '.flac' END AS last_processed_filename FROM supplier)"""


def feeds(spark, sf_dir):
    key, now = F.col("s_suppkey"), F.lit(NOW).cast("timestamp")
    names = ["unclaimed", "active", "failing", "quarantined", "deactivated"]
    status = F.element_at(F.array(*[F.lit(n) for n in names]), (key % 5 + 1).cast("int"))
    later = F.make_dt_interval(secs=((key % 4 - 2) * 60).cast("decimal(18,6)"))
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        status.alias("status"),
        F.when(key % 5 == 1, F.concat(F.lit("w"), (key % 3).cast("string"))).alias("worker_id"),
        F.when(key % 5 != 0, now - F.make_dt_interval(secs=(key % 200).cast("decimal(18,6)"))).alias("last_heartbeat"),
        F.when((key % 5 == 2) & (key % 4 > 0), now + later).alias("retry_after"),
        (key % 7).alias("failure_count"),
        (key % 4).alias("fencing_token"),
        F.concat(F.lit("type"), (F.col("s_nationkey") % 3).cast("string")).alias("source_type"),
        F.when(key % 3 > 0, F.concat(F.lit("f"), key.cast("string"), F.lit(".flac"))).alias("last_processed_filename"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


_ELIGIBLE = f"""(status = 'unclaimed' OR (status = 'failing' AND (retry_after IS NULL OR retry_after <= TIMESTAMP '{NOW}'))
  OR (status = 'active' AND last_heartbeat < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND))"""
_PRIORITY = "ORDER BY (status = 'unclaimed') DESC, retry_after ASC NULLS FIRST, last_heartbeat ASC NULLS FIRST, id"
_URLS = "(SELECT c_custkey AS id, 'http://' || c_name AS stream_url FROM customer WHERE c_custkey % 2 = 0)"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("http://"), "c_name").alias("stream_url")
    )


@query(
    f"""SELECT id, 'active' AS status, 'me' AS worker_id, fencing_token + 1 AS fencing_token, failure_count, name, source_type, last_processed_filename, stream_url
        FROM (SELECT * FROM {_FEEDS} WHERE {_ELIGIBLE} {_PRIORITY} LIMIT 25) LEFT JOIN {_URLS} USING (id)"""
)
def lease_acquire(spark, sf_dir):
    got = tables.lease(feeds(spark, sf_dir), _urls(spark, sf_dir), "me", _now(), LeaseConfig(limit=25))
    return got.drop("last_heartbeat")


@query(
    f"""WITH l AS (SELECT id FROM {_FEEDS} WHERE {_ELIGIBLE} {_PRIORITY} LIMIT 25)
        SELECT id, CASE WHEN l.id IS NULL THEN status ELSE 'active' END AS status, CASE WHEN l.id IS NULL THEN worker_id ELSE 'me' END AS worker_id,
        fencing_token + CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS fencing_token FROM {_FEEDS} f LEFT JOIN l USING (id)"""
)
def lease_state_after(spark, sf_dir):
    own = feeds(spark, sf_dir)
    got = tables.lease(own, _urls(spark, sf_dir), "me", _now(), LeaseConfig(limit=25))
    return tables.apply_lease(own, got).select("id", "status", "worker_id", "fencing_token")


@query(
    f"""SELECT id, status, worker_id, status = 'active' AND worker_id IS NOT DISTINCT FROM 'w1' AS renewed FROM {_FEEDS} WHERE id % 2 = 1"""
)
def heartbeat_diag(spark, sf_dir):
    own = feeds(spark, sf_dir)
    return tables.heartbeats(own, own.where("id % 2 = 1").select("id"), "w1")


@query(
    f"""SELECT id, CASE WHEN failure_count + 1 >= 5 THEN 'quarantined' ELSE 'failing' END AS status, failure_count + 1 AS failure_count,
        CASE WHEN failure_count + 1 < 5 THEN least(600.0, 15.0 * pow(2.0, failure_count)) END AS retry_in_s FROM {_FEEDS} WHERE status = 'active'"""
)
def report_failure(spark, sf_dir):
    own = feeds(spark, sf_dir)
    failed = own.where("status = 'active'").select("id")
    out = tables.report_failure(own, failed, _now(), LeaseConfig(), F.lit(0.0))
    return out.select("id", "status", "failure_count", "retry_in_s")


@query(
    f"""SELECT id, 'w1' AS worker_id, id % 3 AS fencing_token, status = 'active' AND worker_id = 'w1' AND id % 4 = id % 3 AS done
        FROM {_FEEDS} WHERE status = 'active' AND worker_id IS NOT NULL"""
)
def fenced_progress(spark, sf_dir):
    own = feeds(spark, sf_dir).where("status = 'active' AND worker_id IS NOT NULL")
    asked = own.select("id", F.lit("w1").alias("worker_id"), (F.col("id") % 3).alias("fencing_token"))
    return tables.fenced(own, asked)


_ASKED = f"(SELECT id, 'w1' AS worker_id, id % 3 AS fencing_token, 'f' || id AS name FROM {_FEEDS} WHERE id % 3 <> 2)"
_HELD = "a.id IS NOT NULL"


def _asked(own):
    asked = own.where("id % 3 <> 2").select(
        "id", F.lit("w1").alias("worker_id"), (F.col("id") % 3).alias("fencing_token"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("last_processed_filename"),
    )
    return asked.unionByName(asked)  # a request that is sent twice


@query(
    f"""SELECT f.id, f.status, f.worker_id, f.fencing_token, CASE WHEN {_HELD} THEN a.name ELSE 'none' END AS last_processed_filename,
        CASE WHEN {_HELD} THEN 0 ELSE failure_count END AS failure_count, {_HELD} AS updated
        FROM {_FEEDS} f LEFT JOIN {_ASKED} a ON a.id = f.id AND a.worker_id = f.worker_id AND a.fencing_token = f.fencing_token"""
)
def fenced_progress_state(spark, sf_dir):
    own = feeds(spark, sf_dir).withColumn("last_processed_filename", F.lit("none"))
    out = tables.progress(own, _asked(own), _now())
    return out.select("id", "status", "worker_id", "fencing_token", "last_processed_filename", "failure_count", "updated")


@query(
    f"""SELECT f.id, CASE WHEN {_HELD} THEN 'unclaimed' ELSE f.status END AS status, CASE WHEN {_HELD} THEN NULL ELSE f.worker_id END AS worker_id, {_HELD} AS updated
        FROM {_FEEDS} f LEFT JOIN {_ASKED} a ON a.id = f.id AND a.worker_id = f.worker_id AND a.fencing_token = f.fencing_token"""
)
def fenced_release_state(spark, sf_dir):
    own = feeds(spark, sf_dir)
    return tables.fenced_release(own, _asked(own), _now()).select("id", "status", "worker_id", "updated")


@query(
    f"""SELECT count(*) AS n_rows, count(*) FILTER ({_HELD}) AS updated
        FROM {_FEEDS} f LEFT JOIN {_ASKED} a ON a.id = f.id AND a.worker_id = f.worker_id AND a.fencing_token = f.fencing_token"""
)
def affected_rows(spark, sf_dir):
    own = feeds(spark, sf_dir)
    return tables.affected(tables.fenced_release(own, _asked(own), _now()))


@query(f"SELECT id, 'unclaimed' AS status FROM {_FEEDS} WHERE status = 'active' AND worker_id = 'w2'")
def release_batch(spark, sf_dir):
    return tables.release(feeds(spark, sf_dir), "w2").select("id", "status")


@query(f"SELECT id FROM {_FEEDS} WHERE status = 'active' EXCEPT SELECT id FROM {_FEEDS} WHERE worker_id = 'w1' AND status = 'active'")
def lost_leases(spark, sf_dir):
    return tables.lost(feeds(spark, sf_dir), "w1")


# manifests


@query(
    """SELECT o_orderkey, a, b AS matched_offset, coalesce(l, -1) AS line FROM (
       SELECT o_orderkey, round(o_totalprice % 60, 4) AS a, b, l, row_number() OVER (PARTITION BY o_orderkey ORDER BY l, b) AS k
       FROM orders LEFT JOIN (SELECT l_orderkey, round(l_extendedprice % 60, 4) AS b, l_linenumber AS l FROM lineitem) x
       ON l_orderkey = o_orderkey AND abs(round(o_totalprice % 60, 4) - b) < 5.0) WHERE k = 1"""
)
def tolerance_join_first(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.round(F.col("o_totalprice") % 60, 4).alias("a")
    )
    right = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.round(F.col("l_extendedprice") % 60, 4).alias("b"),
        F.col("l_linenumber").alias("l"),
    )
    out = tables.tolerance_first(left, right, "o_orderkey", "a", "b", 5.0, "l")
    return out.select("o_orderkey", "a", F.col("found.b").alias("matched_offset"), F.coalesce(F.col("found.l"), F.lit(-1)).alias("line"))


@query(
    """SELECT k, x.s AS status, pred_text_a, y.p AS pred_text_b FROM (
         SELECT o_orderkey * 1000003 AS k, o_orderstatus AS s, o_clerk_ AS pred_text_a, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT *, o_custkey AS o_clerk_ FROM orders)) x
       JOIN (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) y USING (n)"""
)
def positional_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") * 1000003)
    a = orders.select("k", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("pred_text_a"))
    b = orders.select("k", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("pred_text_b"))
    return streams.merged_by_place(a, b, "k", ("status",))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_antijoin(spark, sf_dir):
    return tables.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query(
    """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM supplier s
       WHERE contains('gs://b/x_' || s_suppkey * 37 || '.flac__seg000', o_orderkey || '.flac'))"""
)
def pending_names(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("gs://raw/"), F.col("o_orderkey").cast("string"), F.lit(".flac")).alias("path")
    )
    done = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("gs://b/x_"), (F.col("s_suppkey") * 37).cast("string"), F.lit(".flac__seg000")).alias("name")
    )
    return tables.pending_names(wanted, done, "path", "name", lambda n: C.ends_before(n, ".flac")).select("o_orderkey")


@query("SELECT doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS prediction, l.doc_id IS NULL AS unmatched FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = tables.with_default(docs, table(spark, sf_dir, "labels"), "doc_id", "quality", F.lit(""))
    return found.withColumnRenamed("quality", "prediction")


@query(
    """SELECT doc_id, CAST(i - 1 AS INT) AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
       WHERE """
    + _SAYS.format(t="lines[i]")
)
def explode_nested(spark, sf_dir):
    return tables.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """SELECT p_partkey, 'brand' AS model, p_brand AS pred_text FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part"""
)
def unpivot_long(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("pred_text_brand"),
        F.col("p_type").alias("pred_text_type"),
        F.col("p_name").alias("pred_text_name"),
    )
    return words.to_long(wide, ["p_partkey"])


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
       count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id"""
)
def pivot_wide(spark, sf_dir):
    return tables.pivot_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "purchase", "view"])


_NORMAL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace({t}, '<[^>]+>', '', 'g'), '\[[^\]]+\]', '', 'g'), '_+', '', 'g')), '-', ' '),
    '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:(?:uh|um|ah|er)(?:([^\p{{L}}\p{{M}}\p{{N}}_])(?:uh|um|ah|er))*)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \3', 'g'),
    '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(uh|um|ah|er)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1\3', 'g'),
    '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(uh|um|ah|er)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1\3', 'g'),
  'won''t', 'will not'), 'can''t', 'can not'), 'let''s', 'let us'), 'n''t', ' not'), '''re', ' are'), '''s', ' is'), '''d', ' would'), '''ll', ' will'), '''t', ' not'), '''ve', ' have'), '''m', ' am'),
  '[!-/:-@\[-`{{-~]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"""


@query("SELECT doc_id, " + _NORMAL.format(t="coalesce(text, '')") + " AS normal FROM documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.normalise(F.coalesce("text", F.lit(""))).alias("normal")
    )


def _pairs(spark, sf_dir):
    """Every turn with two predictions of it: the turn after it (empty for the last), and its own words but the short ones."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("pred_text_reply")
    )
    return turns.withColumn("pred_text_long", F.regexp_replace("text", "(^| )[a-z]{1,3}( |$)", " "))


_TURNS = """(SELECT conv_id, turn, coalesce(text, '') AS text,
  coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS reply FROM conversations)"""
# costs and counts of an alignment in one number: cost, hits, substitutions, deletions, insertions
_HIT, _SUB, _DEL, _INS = 1 << 36, (1 << 48) + (1 << 24), (1 << 48) + (1 << 12), (1 << 48) + 1
_WORDS = "list_filter(string_split({t}, ' '), lambda w: w <> '')"
_ERRORS = f"""
WITH RECURSIVE q AS (
  SELECT conv_id, turn, text, unnest(['long', 'reply']) AS model,
         unnest([regexp_replace(text, '(^| )[a-z]{{1,3}}( |$)', ' ', 'g'), reply]) AS said FROM {_TURNS}),
m AS (
  SELECT conv_id, turn, model, {_NORMAL.format(t="coalesce(text, '')")} AS text, {_NORMAL.format(t="coalesce(said, '')")} AS said FROM q),
p AS (SELECT conv_id, turn, model, {_WORDS.format(t="text")} AS a, {_WORDS.format(t="said")} AS b FROM m),
r(conv_id, turn, model, a, b, i, costs) AS (
  SELECT conv_id, turn, model, a, b, 0, list_transform(range(0, len(b) + 1), lambda j: j * {_INS}) FROM p
  UNION ALL
  SELECT conv_id, turn, model, a, b, i + 1,
         list_reduce(list_prepend([costs[1] + {_DEL}], list_transform(range(1, len(b) + 1),
             lambda j: [costs[j] + CASE WHEN a[i + 1] = b[j] THEN {_HIT} ELSE {_SUB} END, costs[j + 1] + {_DEL}])),
           lambda done, x: list_append(done, CASE
             WHEN (done[-1] + {_INS}) >> 48 < least(x[1] >> 48, x[2] >> 48) THEN done[-1] + {_INS}
             WHEN x[2] >> 48 < x[1] >> 48 THEN x[2] ELSE x[1] END))
  FROM r WHERE i < len(a)),
e AS (
  SELECT conv_id, turn, model, (costs[-1] >> 36) & 4095 AS hits, (costs[-1] >> 24) & 4095 AS substitutions,
         (costs[-1] >> 12) & 4095 AS deletions, costs[-1] & 4095 AS insertions FROM r WHERE i = len(a))
"""
_RATE = "((substitutions + deletions + insertions) * 20000 + n) // (2 * nullif(n, 0)) / 100.0"


@query(_ERRORS + f"SELECT * EXCLUDE n, {_RATE} AS wer FROM (SELECT *, hits + substitutions + deletions AS n FROM e)")
def wer_samples(spark, sf_dir):
    return words.word_errors(words.to_long(_pairs(spark, sf_dir), ["conv_id", "turn", "text"]), "text", "pred_text")


@query(
    _ERRORS
    + f"""SELECT *, {_RATE} AS wer FROM (
        SELECT model, CAST(sum(hits + substitutions + deletions) AS BIGINT) AS n_words, CAST(sum(substitutions) AS BIGINT) AS substitutions,
               CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(insertions) AS BIGINT) AS insertions,
               CAST(sum(hits + substitutions + deletions) AS BIGINT) AS n FROM e GROUP BY model)""".replace("SELECT *, ", "SELECT * EXCLUDE n, ", 1)
)
def wer_leaderboard(spark, sf_dir):
    return words.leaderboard(wer_samples(spark, sf_dir))


@query(
    f"""SELECT conv_id, turn, CAST(list_reduce(list_prepend(0, list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] IS NOT DISTINCT FROM b[i] THEN 0 ELSE 1 END)), lambda x, y: x + y) AS BIGINT) AS n_differences,
       CAST(len(a) AS BIGINT) AS n_words FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(reply, ' ') AS b FROM {_TURNS})"""
)
def positional_differences(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select(
        "conv_id", "turn", F.split("text", " ").alias("a"), F.split("pred_text_reply", " ").alias("b")
    )
    differs = F.zip_with("a", "b", lambda x, y: (~x.eqNullSafe(y)).cast("long"))
    return pairs.select(
        "conv_id",
        "turn",
        F.aggregate(differs, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_differences"),
        F.size("a").cast("long").alias("n_words"),
    )


# generators, batches, selection


@query(
    """SELECT n_nationkey, CAST(d AS VARCHAR) AS day, CAST(h AS BIGINT) AS hour, n_name || '/' || strftime(d, '%Y%m%d') || '_' || lpad(CAST(h AS VARCHAR), 2, '0') || '.mp3' AS path
       FROM nation, (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS d FROM range(3) t(i)), range(24) u(h)"""
)
def candidate_grid(spark, sf_dir):
    prefixes = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return files.candidate_paths(prefixes, "n_name", "2024-01-01", "2024-01-03").select(
        "n_nationkey", F.col("day").cast("string").alias("day"), F.col("hour").cast("long").alias("hour"), "path"
    )


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS batch FROM documents")
def batch_of_15(spark, sf_dir):
    rows = streams.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", F.floor(F.col("number") / 15).cast("long").alias("batch"))


@query(
    """SELECT o_orderkey, l_linenumber, lpad(CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS VARCHAR), 3, '0') AS segment_id
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
)
def segment_ordinal(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    n = streams.tasks_for(lines)  # the window keeps the join's partitions
    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(n, "o_orderkey")
    both = lines.repartition(n, "o_orderkey").join(orders, "o_orderkey")
    placed = streams.within_key(both, "o_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"])
    return placed.select("o_orderkey", "l_linenumber", F.lpad(F.col("place").cast("string"), 3, "0").alias("segment_id"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_type IS NOT NULL AND p_retailprice > 0")
def feed_selection(spark, sf_dir):
    known = table(spark, sf_dir, "part").where(F.col("p_type").isNotNull())
    positive = tables.large_enough(known, "p_retailprice", 0, strict=True)
    return tables.large_enough(positive, "p_size", 10).select("p_partkey", "p_size")


@query("SELECT count(*) AS checked, count(*) FILTER (l_quantity >= 25) AS found, count(*) FILTER (l_quantity < 25) AS failed FROM lineitem")
def counters(spark, sf_dir):
    n = F.col("l_quantity")
    return tables.tally(table(spark, sf_dir, "lineitem"), found=n >= 25, failed=n < 25)


_NAMES = "CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'same' || s_suppkey % 3 ELSE s_name END"


@query(
    f"""WITH f AS (SELECT s_suppkey AS id, {_NAMES} AS name, s_nationkey AS source_type FROM supplier)
        SELECT id, 'null name' AS rule FROM f WHERE name IS NULL
        UNION ALL SELECT id, 'name not unique' FROM f WHERE name IN (SELECT name FROM f GROUP BY name HAVING count(*) > 1)
        UNION ALL SELECT id, 'unknown source type' FROM f WHERE source_type NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"""
)
def constraint_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.expr(_NAMES.replace("||", "||")).alias("name"), F.col("s_nationkey").alias("source_type")
    )
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("slug"))
    return tables.violations(rows, known)


# rule tables

_KEYWORDS = "lower(substr(n_name, 1, 3))"


def _stored_rules(spark, sf_dir):
    """A rule a nation: its first letters anywhere in a text; some inactive, some for one feed, some broken."""
    key, letters = F.col("n_nationkey"), F.lower(F.substring("n_name", 1, 3))
    scope = F.struct(
        F.when(key % 7 == 3, F.lit("FEED_SPECIFIC")).otherwise(F.lit("GLOBAL")).alias("level"),
        F.when(key % 7 == 3, F.array(F.lit("de"))).alias("target_feeds"),
    )
    conditions = F.struct(
        F.when(key % 6 == 5, F.lit("NONE")).otherwise(F.lit("KEYWORD_MATCH")).alias("evaluation_type"),
        F.array(letters).alias("keywords"),
    )
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 2, "0")).alias("rule_id"),
        (key % 5 != 4).alias("is_active"),
        F.to_json(scope).alias("scope"),
        F.to_json(conditions).alias("conditions"),
        F.lit(NOW).cast("timestamp").alias("updated_at"),
    )


@query(
    f"""SELECT doc_id, string_agg(rule_id, ',' ORDER BY rule_id) AS decisions FROM documents JOIN (
          SELECT 'r' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rule_id, {_KEYWORDS} AS word, n_nationkey % 7 = 3 AS own
          FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 6 <> 5) r
        ON contains(lower(text), word) AND (NOT own OR lang = 'de') GROUP BY doc_id"""
)
def rule_table_eval(spark, sf_dir):
    known = rules.load(rules.parse(_stored_rules(spark, sf_dir)))
    out = tables.flagged(tables.evaluate(table(spark, sf_dir, "documents"), known, feed="lang"))
    return out.select("doc_id", F.array_join("decisions", ",").alias("decisions"))


@query(
    """SELECT 'r' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rule_id, n_nationkey % 5 <> 4 AS is_active,
       CASE WHEN n_nationkey % 6 = 5 THEN 'bad evaluation type' ELSE 'none' END AS error, lower(substr(n_name, 1, 3)) AS keywords,
       CASE WHEN n_nationkey % 7 = 3 THEN 'FEED_SPECIFIC' ELSE 'GLOBAL' END AS level FROM nation"""
)
def rule_table_parse(spark, sf_dir):
    parsed = rules.listed(rules.parse(_stored_rules(spark, sf_dir)))
    return parsed.select(
        "rule_id", "is_active", F.coalesce("error", F.lit("none")).alias("error"), F.array_join("keywords", ",").alias("keywords"), "level"
    )


@query(
    f"""SELECT rule_id, CASE WHEN k % 4 = 0 THEN false ELSE is_active END AS is_active,
       CASE WHEN k % 4 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 1 HOUR ELSE TIMESTAMP '{NOW}' END AS updated_at FROM (
         SELECT 'r' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rule_id, n_nationkey AS k, n_nationkey % 5 <> 4 AS is_active FROM nation WHERE n_nationkey % 8 <> 1
         UNION ALL SELECT 's' || r_regionkey, 1, true FROM region)"""
)
def rule_table_changes(spark, sf_dir):
    stored = _stored_rules(spark, sf_dir)
    key = F.substring("rule_id", 2, 2).cast("int")
    new = table(spark, sf_dir, "region").select(
        F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.lit(True).alias("is_active"),
        F.lit("{}").alias("scope"), F.lit("{}").alias("conditions"), F.lit(NOW).cast("timestamp").alias("updated_at"),
    )
    changes = stored.where(key % 4 == 0).select("rule_id", F.lit(False).alias("is_active"), F.lit(None).cast("string").alias("scope"))
    after = rules.update(stored, changes, F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    after = rules.delete(after, stored.where(key % 8 == 1).select("rule_id"))
    return rules.create(rules.create(after, new), stored.where(key % 8 != 1)).select("rule_id", "is_active", "updated_at")


_ONES, _TENS, _SCALES = (f"string_split('{w}', ' ')" for w in (C.ONES, C.TENS, C.SCALES))
_GROUP = f"""concat_ws(' ', CASE WHEN n >= 100 THEN {_ONES}[n // 100 + 1] || ' hundred' END,
  CASE WHEN n % 100 >= 20 THEN {_TENS}[n % 100 // 10 - 1] WHEN n % 100 > 0 THEN {_ONES}[n % 100 + 1] END,
  CASE WHEN n % 100 >= 20 AND n % 10 > 0 THEN {_ONES}[n % 10 + 1] END, CASE WHEN g < 7 THEN {_SCALES}[g] END)"""



@query(f"""
WITH p AS (
  SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_extract_all(text, '[0-9]+|[^0-9]+') END AS p FROM documents)),
d AS (SELECT DISTINCT p FROM p WHERE regexp_matches(p, '^[0-9]') AND length(p) <= 21),
n AS (
  SELECT p, g, CAST(substr(lpad(p, 21, '0'), 3 * g - 2, 3) AS INT) AS n FROM d, (SELECT unnest(range(1, 8)) AS g)),
w AS (SELECT p, coalesce(string_agg({_GROUP}, ' ' ORDER BY g) FILTER (n > 0), 'zero') AS said FROM n GROUP BY p)
SELECT doc_id, string_agg(coalesce(said, CASE WHEN regexp_matches(p.p, '^[0-9]') THEN
         array_to_string(list_transform(string_split(p.p, ''), lambda c: {_ONES}[CAST(c AS INT) + 1]), ' ') ELSE p.p END),
       '' ORDER BY k) AS said
FROM p LEFT JOIN w ON w.p = p.p GROUP BY doc_id
""")
def digits_to_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.digits_to_words(F.coalesce("text", F.lit(""))).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN props END AS payload FROM events")
def cloud_event_decode(spark, sf_dir):
    data = F.when(F.col("event_id") % 7 != 0, F.base64(F.encode("props", "UTF-8")))
    body = F.to_json(F.struct(F.struct(F.struct(data.alias("data")).alias("message")).alias("data")))
    envelopes = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return envelopes.select("event_id", C.cloud_event_payload(F.col("body")).alias("payload"))


# nested data, samples and urls


@query(
    """SELECT conv_id, string_agg(turn || ':' || said, '|' ORDER BY turn) AS segments FROM (
        SELECT u.conv_id, u.turn, trim(a.text) AS said FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role <> 'user' AND trim(coalesce(a.text, '')) <> '') GROUP BY conv_id"""
)
def region_text_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    entry = F.struct(
        F.when(user, F.col("turn") + 1).otherwise(F.col("turn")).alias("id"),
        F.when(user, F.lit("labels")).otherwise(F.lit("textarea")).alias("type"),
        F.when(user, F.col("turn")).alias("start"),
        F.when(user, F.col("turn") + 1).alias("end"),
        F.when(~user, F.array(F.coalesce("text", F.lit("")))).alias("texts"),
    )
    tasks = turns.groupBy("conv_id").agg(F.collect_list(entry).alias("result"))
    tasks = tasks.select(F.col("conv_id").cast("string").alias("audio"), F.array(F.struct("result")).alias("annotations"))
    said = F.transform(
        F.array_sort("segments"), lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["text"])
    )
    return nested.region_segments(tasks, "audio", "annotations").select(
        F.col("audio_path").cast("long").alias("conv_id"), F.array_join(said, "|").alias("segments")
    )


@query(
    """SELECT c_custkey, o_orderkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer JOIN (
        SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""
)
def last_wins_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    last = nested.last_wins(orders.withColumn("at", F.col("o_orderkey")), "o_custkey", "at")
    out = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"))
    return out.select("c_custkey", "o_orderkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))


@query(
    """SELECT 'gs://b/' || l_orderkey || '/' || l_linenumber AS uri, CAST(l_linenumber % 3 AS INT) AS code, l_returnflag AS message
       FROM lineitem WHERE l_linenumber % 3 <> 0"""
)
def failed_batch_results(spark, sf_dir):
    uri = F.concat_ws("/", F.lit("gs:/"), F.lit("b"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    answer = F.struct((F.col("l_linenumber") % 3).cast("int").alias("code"), F.col("l_returnflag").alias("message"))
    results = table(spark, sf_dir, "lineitem").select(F.create_map(uri, answer).alias("results"))
    return nested.failed_results(results, "results")


@query(
    """SELECT user_id, string_agg(event_type || '=' || ms, ',' ORDER BY event_type) AS entries FROM (
        SELECT user_id, event_type, max(epoch_us(ts) // 1000) AS ms FROM events GROUP BY user_id, event_type) GROUP BY user_id"""
)
def offset_maps(spark, sf_dir):
    found = nested.maps_by(_events(spark, sf_dir), "user_id", "event_type", "ms")
    said = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("user_id", F.array_join(said, ",").alias("entries"))


@query("SELECT event_id FROM events ORDER BY md5('11:' || event_id), event_id LIMIT 500")
def sampled_streams(spark, sf_dir):
    return nested.sampled(table(spark, sf_dir, "events").select("event_id"), "event_id", 500, 11)


@query("SELECT doc_id, replace(url_encode(text), '%2F', '/') AS quoted FROM documents")
def url_quoting(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", remote.url_quoted(F.col("text")).alias("quoted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
