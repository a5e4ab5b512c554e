"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import answers as p3
from lodestone.llm import conversations as p2
from lodestone.llm import docpairs as p1
from lodestone.llm import leakage as p8
from lodestone.llm import mixing as p9
from lodestone.llm import mojibake as p10
from lodestone.llm import neardup as p7
from lodestone.llm import secrets as p5
from lodestone.llm import splitting as p6
from lodestone.llm import truncation as p4
from lodestone.session import arrow_batch_rows
from lodestone.sources.tables import table


def _functions(spark: SparkSession, d: str, with_source: bool) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    whole = p1.documented_functions(table(spark, d, "sessions"), "id", "code", "sessions", with_source=with_source)
    chunks = p1.documented_functions(table(spark, d, "code_chunks"), "id", "chunk_text", "code_chunks", chunk=True, with_source=with_source)
    return whole.unionByName(chunks)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d, False).select("src_table", "row_id", "def_line").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d, True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2.conversation_defects(table(spark, d, "chat_messages"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages")
    turns = p2.conversations(m, p2.calibrated_gap(m))
    return turns.select("session_id", "part", "n_turns", F.to_json("turns").alias("turns"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 4000)
    return p3.answer_defects(table(spark, d, "chat_messages"), table(spark, d, "documents"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 4000)
    return p4.message_rows(table(spark, d, "chat_messages")).unionByName(p4.title_rows(table(spark, d, "sessions")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.cut_rows(_texts(spark, d))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return p4.cut_shares(_texts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    whole = p5.find_secrets(table(spark, d, "sessions"), "id", "code", "sessions")
    chunks = p5.find_secrets(table(spark, d, "code_chunks"), "id", "chunk_text", "code_chunks")
    return whole.unionByName(chunks).select("src_table", "row_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    whole = p5.redact_secrets(table(spark, d, "sessions"), "id", "code", "sessions")
    return whole.unionByName(p5.redact_secrets(table(spark, d, "code_chunks"), "id", "chunk_text", "code_chunks"))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    tables = {t: table(spark, d, t) for t in ("sessions", "code_chunks")}
    return p6.split_by_limits(tables, table(spark, d, "size_limits"), with_text)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).select("src_table", "row_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    return p7.near_duplicate_pairs(table(spark, d, "sessions"), "id", "code", 0.6)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 1000)
    return p7.near_duplicate_groups(table(spark, d, "sessions"), "id", "code", 0.6)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 2000)
    return p8.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 24 words with up to two wrong ones."""
    arrow_batch_rows(spark, 2000)
    return p8.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), 24, 2)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 2000)
    return p9.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 2000)
    return p9.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 2000)
    return p10.garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    arrow_batch_rows(spark, 2000)
    return p10.garbled(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_conversations": p2_conversations,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}

#: One row for each message, in order, with cleaned role and blankness.
_MESSAGES = r"""
WITH m AS (
  SELECT session_id, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS role, content, created_at, min(id) AS id
  FROM chat_messages WHERE session_id IS NOT NULL GROUP BY 1, 2, 3, 4
), o AS (
  SELECT *, NOT coalesce(regexp_matches(content, '[^\p{Z}\p{C}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}]'), false) AS blank,
    lag(coalesce(role, '')) OVER w AS before,
    row_number() OVER w AS rn, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rd
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id)
)
"""

ORACLES: dict[str, str] = {
    "p2_found": _MESSAGES
    + """
, s AS (
  SELECT session_id, bool_and(blank) AS all_blank,
    bool_or(coalesce(role, '') NOT IN ('user', 'assistant') OR (rn = 1 AND role <> 'user') OR coalesce(role, '') = before OR (blank AND role = 'user')) AS broken,
    bool_or((rd = 1 AND role = 'user') OR (blank AND role = 'assistant')) AS missing
  FROM o GROUP BY 1
)
SELECT session_id, CASE WHEN all_blank THEN 'empty' WHEN broken THEN 'broken' ELSE 'missing_reply' END AS defect
FROM s WHERE all_blank OR broken OR missing
""",
    "p6_found": """
SELECT DISTINCT l.src_table, r.id AS row_id FROM size_limits l JOIN (
  SELECT 'sessions' AS t, 'code' AS f, id, strlen(code) AS n FROM sessions
  UNION ALL SELECT 'code_chunks', 'chunk_text', id, strlen(chunk_text) FROM code_chunks
) r ON r.t = l.src_table AND r.f = l.field AND r.n > l.max_bytes
""",
    "p8_found": r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM eval_items),
dg AS (SELECT id, unnest([array_to_string(w[k:k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS g FROM d),
ig AS (SELECT DISTINCT id, unnest([array_to_string(w[k:k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS g FROM i)
SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)
""",
    "p7_found": r"""
WITH w AS (SELECT DISTINCT id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS w FROM sessions WHERE code IS NOT NULL),
g AS (SELECT DISTINCT id, unnest([array_to_string(w[k:k + 2], ' ') FOR k IN range(1, len(w) - 1)]) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT x AS session_a, y AS session_b FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE k >= 0.6 * (p.n + q.n - k)
UNION
SELECT a.id, b.id FROM sessions a JOIN sessions b ON a.code = b.code AND a.id < b.id
""",
}
