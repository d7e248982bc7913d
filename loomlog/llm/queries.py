"""Queries of the language-model data problems (2, 4, 7, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import conversations, language, mixing, packing, splitting, truncation
from loomlog.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that are broken, empty or lack replies."""
    return conversations.found(spark, f"{folder}/response_items.parquet")


def p2_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The other sessions as ordered conversations."""
    return conversations.conversations(spark, f"{folder}/response_items.parquet")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a text that was cut off."""
    return truncation.found(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut records of each source."""
    return truncation.rates(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden storage limits of the sources."""
    texts = truncation.texts(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))
    return truncation.limits(truncation.measured(texts)).drop("rank")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that force a cut inside a line."""
    return splitting.forced_lines(table(spark, folder, "archive_members"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every oversized member."""
    return splitting.pieces(table(spark, folder, "archive_members")).drop("end_line_no")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document placed in a container of each kind."""
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Used space of each kind of container."""
    return packing.fill(p8_packing(spark, folder))


def p8_search(spark: SparkSession, folder: str) -> DataFrame:
    """What the search did: cells, cells evolved, least possible containers, those of best fit and those of the result."""
    return packing.pack_with_search(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))[1]


def p8_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed, and breaches of what a placement promises, of each kind of container."""
    return packing.promises(p8_packing(spark, folder), table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mix with their copies."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p9_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of what a mix promises, of each source."""
    return mixing.promises(p9_mix(spark, folder), table(spark, folder, "source_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of documents with a missing or wrong label, and of mixed documents."""
    return language.found(table(spark, folder, "documents"))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each segment of each document."""
    return language.labelled(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_conversations, p4_found, p4_rates, p4_limits, p7_found, p7_pieces, p8_packing, p8_fill, p8_search, p8_promises, p9_mix, p9_shares, p9_promises, p10_found, p10_segments)
}

SQL = {
    "p2_conversations": r"""WITH r AS (SELECT session_id, lower(trim(payload.role)) AS role, list_transform(payload.content, lambda p: p.text) AS texts,
TRY_CAST(CASE WHEN regexp_matches(trim(timestamp), '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$') THEN trim(timestamp) END AS TIMESTAMPTZ) AS instant
FROM response_items WHERE type = 'response_item' AND payload.type = 'message'
AND coalesce(list_bool_or(list_transform(payload.content, lambda p: coalesce(regexp_matches(p.text, '[^\s\p{Z}\p{Cc}\p{Cf}]'), false))), false)),
m AS (SELECT DISTINCT session_id, instant, texts, CASE WHEN role IN ('user', 'human') THEN 'u' WHEN role IN ('assistant', 'model') THEN 'a' ELSE 'x' END AS who FROM r
WHERE role IS NULL OR role NOT IN ('system', 'developer', 'tool')),
o AS (SELECT *, array_to_string(list_filter(texts, lambda t: t IS NOT NULL), chr(10)) AS said FROM m),
n AS (SELECT *, row_number() OVER w AS k, lead(who) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY session_id ORDER BY instant, who DESC, said, texts)),
v AS (SELECT session_id FROM n GROUP BY session_id HAVING bool_or(who = 'x' OR instant IS NULL OR (k = 1 AND who = 'a') OR (who = 'u' AND nxt IS DISTINCT FROM 'a')))
SELECT session_id, k - 1 AS position, epoch_us(instant) AS instant_us, CASE who WHEN 'a' THEN 'assistant' ELSE 'user' END AS role, said AS text FROM n WHERE session_id NOT IN (SELECT session_id FROM v WHERE session_id IS NOT NULL)""",
    "p2_found": r"""WITH r AS (SELECT session_id, lower(trim(payload.role)) AS role, list_transform(payload.content, lambda p: p.text) AS texts,
TRY_CAST(CASE WHEN regexp_matches(trim(timestamp), '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$') THEN trim(timestamp) END AS TIMESTAMPTZ) AS instant
FROM response_items WHERE type = 'response_item' AND payload.type = 'message'
AND coalesce(list_bool_or(list_transform(payload.content, lambda p: coalesce(regexp_matches(p.text, '[^\s\p{Z}\p{Cc}\p{Cf}]'), false))), false)),
m AS (SELECT DISTINCT session_id, instant, texts, CASE WHEN role IN ('user', 'human') THEN 'u' WHEN role IN ('assistant', 'model') THEN 'a' ELSE 'x' END AS who FROM r
WHERE role IS NULL OR role NOT IN ('system', 'developer', 'tool')),
o AS (SELECT *, row_number() OVER w AS k, lead(who) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY session_id ORDER BY instant, who DESC, texts)),
v AS (SELECT session_id, bool_or(who = 'x' OR instant IS NULL OR (k = 1 AND who = 'a') OR (who = 'u' AND nxt IS DISTINCT FROM 'a')) AS is_case FROM o GROUP BY session_id)
SELECT s.session_id FROM (SELECT DISTINCT session_id FROM response_items) s LEFT JOIN v ON v.session_id = s.session_id WHERE coalesce(is_case, true)""",
    "p8_promises": """SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS cut_though_fitting, 0 AS cut_too_often, 0 AS overfull, 0 AS missing
FROM pack_limits WHERE capacity_tokens >= 1 GROUP BY container_kind""",
    "p9_promises": "SELECT source, true AS at_target, 0 AS too_often, 0 AS repeated FROM source_targets WHERE target_share > 0 AND source IN (SELECT source FROM documents WHERE text <> '') GROUP BY source",
    "p7_found": """SELECT member_id, CAST(i AS BIGINT) AS line_no FROM (
SELECT member_id, max_bytes, n, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (
SELECT member_id, max_bytes, string_split(body, chr(10)) AS parts, len(string_split(body, chr(10))) AS n FROM archive_members WHERE strlen(body) > max_bytes))
WHERE strlen(line) + CASE WHEN i < n THEN 1 ELSE 0 END > max_bytes""",
}
