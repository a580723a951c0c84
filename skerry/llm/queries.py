"""The ten operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import (
    chat,
    decontaminate,
    langid,
    merkle,
    neardup,
    packing,
    pages,
    pfor,
    repair,
    rules,
    shards,
    toxicity,
    urls,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    """Learns from all labelled rows with a remainder other than 2, and from those only."""
    return toxicity.fit_all(docs, labels.where(_remainder(4) != 2))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "doc_id", "lang")
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.CUT).cast("int").alias("predicted"),
        (F.col("_score") >= toxicity.threshold(model, F.col("lang"))).alias("rejected"),
    )


def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_ledger(_table(spark, sf_dir, "documents"), 8)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), remembered=packing.REMEMBERED_ALONE)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_ids(spark, pfor.write_ids(_table(spark, sf_dir, "documents")))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(3) != 1))
    held = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held)


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.apply_policy(rules.rule_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return ledger.select(
        "doc_id",
        *(F.col(m) for m in rules.MEASURES[:5]),
        (~rules.passes("base")).alias("base_failed"),
        "kept",
        "fail_bits",
        "policy_version",
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to all documents, from the stored ledger."""
    ledger = rules.stored(rules.rule_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    first, *others = [rules.ablation(ledger, policy) for policy in rules.POLICIES]
    for more in others:
        first = first.unionByName(more)
    return first


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(probe).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.report(repair.edit_script(repair.damage(turns)), turns)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(_remainder(7) == 0, 1).otherwise(0)
    found = merkle.verified(merkle.manifest(docs, {"n_chars": more.cast("decimal(20,0)")}))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_jump_hash": op3_jump_hash,
        "op4_best_fit": op4_best_fit,
        "op5_bagminhash": op5_bagminhash,
        "op6_pfor": op6_pfor,
        "op7_ppm": op7_ppm,
        "op8_wrapper": op8_wrapper,
        "op9_rule_ledger": op9_rule_ledger,
        "rule_ablation": rule_ablation,
        "op10_chat": op10_chat,
        "op11_repair": op11_repair,
        "op12_url_filter": op12_url_filter,
        "op13_merkle": op13_merkle,
        "pipeline": pipeline,
    }


_WHITE = r"[\x20\x09-\x0D]"

OP9_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_WHITE}+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_WHITE}', '', 'g') <> '') AS lines
  FROM t),
g AS (SELECT doc_id, unnest(range(len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 5], ' ') AS gram FROM g),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
r AS (
  SELECT doc_id, sum(least(5, gap)) AS n
  FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5) AS gap FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(t, '{_WHITE}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
       + (CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN 10 * n_shouts > 3 * n_words THEN 32 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, bits = 0 AS kept,
       CAST(bits AS BIGINT) AS fail_bits, 'v2' AS policy_version
FROM f
"""

_RULE_BITS = {
    "base": {"few_words": 1, "repeated_words": 2},
    "v1": {"few_words": 1, "repeated_words": 2, "symbols": 4, "repeated_lines": 8},
    "v2": {"few_words": 1, "repeated_words": 2, "symbols": 4, "repeated_lines": 8, "word_length": 16, "shouting": 32},
}
ABLATION_SQL = " UNION ALL ".join(
    f"""SELECT '{policy}' AS policy_version, count(*) AS n_rows, '{rule}' AS rule, count(*) FILTER (fail_bits & {bit} <> 0) AS n_failed,
        count(*) FILTER (fail_bits & {sum(bits.values())} = {bit}) AS n_only FROM ({OP9_SQL})"""
    for policy, bits in _RULE_BITS.items()
    for rule, bit in bits.items()
)

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))
            + length(regexp_replace(role, '[^\]]', '', 'g')) + 11 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

OP3_SQL = r"""
WITH RECURSIVE crc(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, strlen(text) + 1 AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INT) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
jump(doc_id, n, here, nxt, k) AS (
  SELECT doc_id, n, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CASE WHEN doc_id >= 0 THEN CAST(doc_id AS HUGEINT) ELSE CAST(doc_id AS HUGEINT) + 18446744073709551616 END
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, nxt,
         CAST(floor((nxt + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT), k2
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE nxt < n)),
j AS (
  SELECT doc_id, max(here) FILTER (n = 8) AS shard, max(here) FILTER (n = 9) AS grown_shard FROM jump GROUP BY doc_id),
b AS (
  SELECT s.*, j.shard, j.grown_shard, xor(xor(xor(s.doc_id, s.doc_id >> 10), xor(s.doc_id >> 20, s.doc_id >> 30)),
         xor(xor(s.doc_id >> 40, s.doc_id >> 50), s.doc_id >> 60)) & 1023 AS bucket
  FROM s JOIN j ON j.doc_id = s.doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INT) AS grown_shard
FROM b
"""


# crc32 of the text ``b`` of the rows of ``k``, as ``crc(b, c)``
_CRC = """
crc_step(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_step WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8),
crc AS (
  SELECT b, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INT) + 1])), 4294967295) AS c
  FROM (SELECT DISTINCT b FROM k), tab)"""


def _worse(key: str, cost: int, edit: str) -> str:
    """SQL: a suffix, its cost in nine digits and its audit, after one more edit in front."""
    return f"(lpad(CAST(CAST({key}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || {key}[10:])"


def _edits(state: str) -> str:
    """SQL: the best suffix from a row in a state of the grammar (o nothing yet, s, u, a), insertions before it aside."""
    due = {"o": "eu", "s": "eu", "u": "ea", "a": "eu"}[state]
    kept = {"o": {"s": "es", "u": "eu"}, "s": {"u": "eu"}, "u": {"a": "ea"}, "a": {"u": "eu"}}[state]
    keeps = [f"CASE WHEN NOT gone AND initial = '{i}' THEN CASE WHEN cut THEN {_worse(to, 3, 'K')} ELSE {_worse(to, 0, 'K')} END ELSE '9' END" for i, to in kept.items()]
    rerole = f"CASE WHEN gone THEN '9' WHEN cut THEN {_worse(due, 6, 'R')} ELSE {_worse(due, 3, 'R')} END"
    return f"least({', '.join([_worse(f'e{state}', 4, 'D'), rerole, *keeps])})"


_FAR = "'500000000'"
OP11_SQL = rf"""
WITH RECURSIVE
r0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS b FROM conversations),
k AS (SELECT b FROM r0),
{_CRC},
r1 AS (
  SELECT conv_id, turn, CASE WHEN c % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN c % 20 = 1 THEN '' WHEN c % 20 = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN c % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM r0 JOIN crc ON crc.b = r0.b WHERE c % 20 <> 0),
r2 AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN '' ELSE 'i' || CAST(conv_id AS VARCHAR) END AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
         regexp_replace(text, '[ 	-
]', '', 'g') AS said
  FROM r1),
r AS (
  SELECT *, role[1:1] AS initial, said = '' AS blank, said <> '' AND nth > 1 AS duplicate,
         said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS cut, said = '' OR nth > 1 AS gone,
         count(*) OVER (PARTITION BY conv) AS n,
         lag(role[1:1]) OVER (PARTITION BY conv ORDER BY i) || role[1:1] AS pair
  FROM r2),
suffix(conv, i, eo, es, eu, ea) AS (
  SELECT conv, CAST(n + 1 AS BIGINT), '000000000', '000000006II', '000000003I', '000000000' FROM r WHERE i = 1
  UNION ALL
  SELECT conv, i, least(bo, {_worse("bu", 3, "I")}, {_worse("ba", 6, "II")}), least(bs, {_worse("bu", 3, "I")}, {_worse("ba", 6, "II")}),
         least(bu, {_worse("ba", 3, "I")}), least(ba, {_worse("bu", 3, "I")})
  FROM (SELECT r.conv, r.i, {_edits("o")} AS bo, {_edits("s")} AS bs, {_edits("u")} AS bu, {_edits("a")} AS ba
        FROM suffix JOIN r ON r.conv = suffix.conv AND r.i = suffix.i - 1)),
best AS (SELECT conv, CAST(eo[1:9] AS BIGINT) AS cost, eo[10:] AS audit FROM suffix WHERE i = 1),
walk(conv, pos, i, state, turn_text, audit) AS (
  SELECT conv, 1, 1, 'o', CAST(NULL AS VARCHAR), audit FROM best
  UNION ALL
  SELECT w.conv, pos + 1, CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END,
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN role[1:1] WHEN state = 'u' THEN 'a' ELSE 'u' END,
         CASE WHEN edit = 'D' THEN NULL WHEN edit = 'K' THEN role || ':' || text
              ELSE CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END END,
         audit
  FROM (SELECT *, audit[pos:pos] AS edit FROM walk WHERE pos <= length(audit)) w LEFT JOIN r ON r.conv = w.conv AND r.i = w.i),
said AS (SELECT conv, sha256(coalesce(string_agg(turn_text, chr(10) ORDER BY pos), '')) AS repaired_sha256 FROM walk GROUP BY conv),
facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv),
ids AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN '' ELSE 'i' || CAST(conv_id AS VARCHAR) END AS conv FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv = ids.conv LEFT JOIN best ON best.conv = ids.conv LEFT JOIN said ON said.conv = ids.conv
"""

OP12_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(t, '^[^?#]*(\?[^#]*)?', 1) AS query FROM a),
f AS (
  SELECT page_id, host, path, host || path || query AS u,
         CASE WHEN '.' || host LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN '.' || host LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN '.' || host LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
              WHEN '.' || host LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN '.' || host LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN u LIKE '%/robots.txt' THEN 'allow'
            WHEN u LIKE '%?page=%' OR u LIKE '%&page=%' OR u LIKE '%/login%' OR u LIKE '%/cart/%' OR u LIKE '%sessionid=%'
              OR regexp_full_match(u, '[^/?]*\.[^/?]*/.*/print\.htm[^/?]', 's') THEN 'block'
            ELSE 'allow' END AS verdict
FROM f
"""

_OP13_LEAF = """sha256(
  CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
  || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(length(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR), '-')
  || coalesce(strlen(text) || ':' || text, '-'))"""
_PAIRS = "list_transform(range((len({x}) + 1) // 2), lambda i: sha256({x}[2 * i + 1] || coalesce({x}[2 * i + 2], '')))"
OP13_SQL = f"""
WITH RECURSIVE
d AS (SELECT *, coalesce('=' || lang, '') AS run, CAST(doc_id AS VARCHAR) AS b FROM documents),
k AS (SELECT b FROM d WHERE b IS NOT NULL),
{_CRC},
leaves AS (
  SELECT doc_id, run, {_OP13_LEAF.format(n="n_chars")} AS leaf,
         {_OP13_LEAF.format(n="(n_chars + CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END)")} AS changed
  FROM d LEFT JOIN crc ON crc.b = d.b),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
levels(run, level, nodes) AS (
  SELECT run, 0, list(leaf ORDER BY slot) FROM placed GROUP BY run
  UNION ALL
  SELECT run, level + 1, {_PAIRS.format(x="nodes")} FROM levels WHERE len(nodes) > 1),
subs AS (
  SELECT run, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY run) - 1 AS place FROM levels WHERE len(nodes) = 1),
crown(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subs
  UNION ALL
  SELECT level + 1, {_PAIRS.format(x="nodes")} FROM crown WHERE len(nodes) > 1),
steps AS (
  SELECT p.run, p.slot, p.doc_id, p.leaf, p.changed, l.level, l.nodes, p.slot >> l.level AS pos
  FROM placed p JOIN levels l ON l.run = p.run AND len(l.nodes) > 1
  UNION ALL
  SELECT p.run, p.slot, p.doc_id, p.leaf, p.changed, s.height + c.level, c.nodes, s.place >> c.level
  FROM placed p JOIN subs s ON s.run = p.run JOIN crown c ON len(c.nodes) > 1),
sides AS (
  SELECT run, slot, level, CASE WHEN pos % 2 = 1 THEN nodes[pos] ELSE '' END AS l,
         CASE WHEN pos % 2 = 0 THEN coalesce(nodes[pos + 2], '') ELSE '' END AS r FROM steps),
proof AS (
  SELECT run, slot, string_agg(l || r, '' ORDER BY level) AS proof FROM sides GROUP BY run, slot),
fold(run, slot, level, node) AS (
  SELECT run, slot, 0, changed FROM placed
  UNION ALL
  SELECT f.run, f.slot, f.level + 1, sha256(l || node || r)
  FROM fold f JOIN sides s ON s.run = f.run AND s.slot = f.slot AND s.level = f.level),
ends AS (SELECT run, slot, arg_max(node, level) AS folded_root FROM fold GROUP BY run, slot)
SELECT p.doc_id, p.leaf, s.subroot, c.nodes[1] AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = c.nodes[1] AS verified
FROM placed p JOIN subs s ON s.run = p.run JOIN crown c ON len(c.nodes) = 1
LEFT JOIN proof ON proof.run = p.run AND proof.slot = p.slot JOIN ends e ON e.run = p.run AND e.slot = p.slot
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jump_hash": OP3_SQL,
        "op9_rule_ledger": OP9_SQL,
        "rule_ablation": ABLATION_SQL,
        "op10_chat": OP10_SQL,
        "op11_repair": OP11_SQL,
        "op12_url_filter": OP12_SQL,
        "op13_merkle": OP13_SQL,
    }
