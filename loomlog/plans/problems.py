"""Queries of the general data-preparation problems (1, 3, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.operators import drift, error_parse, shredding, timestamps
from loomlog.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose one determined instant is not written in the plain form."""
    return timestamps.found(table(spark, folder, "rollout_lines"), table(spark, folder, "session_catalog"))


def p1_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with its instant, or null where it is undetermined."""
    lines = timestamps.normalise(table(spark, folder, "rollout_lines"), table(spark, folder, "session_catalog"))
    return lines.select("line_id", "utc_us", F.timestamp_micros("utc_us").alias("utc"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that do not load, with the reason."""
    return error_parse.reasons(table(spark, folder, "raw_items"))


def p3_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that do not load, with the reason, the cost and the edits of the cheapest repair."""
    return error_parse.rejected(table(spark, folder, "raw_items"))


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that load, typed."""
    return error_parse.loaded(table(spark, folder, "raw_items")).withColumn("timestamp", F.unix_micros("timestamp")).withColumnRenamed("timestamp", "utc_us")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of every non-null content part of both tables."""
    parts = shredding.parts(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"), ("type",))
    return parts.select("table_name", "record_id", "entry_pos", "part_pos")


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of replacement-history entries."""
    return shredding.entries(table(spark, folder, "rollout_lines"))


def p5_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of content parts, linked to their entries."""
    return shredding.parts(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each file against the file before it in its stream."""
    return drift.changes(table(spark, folder, "drift_records")).select("file_name", "change", "field_path", "new_path")


def p6_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """In how many records of each file a target field was typed."""
    done = drift.outcomes(drift.ingest(table(spark, folder, "drift_records"), rows=False))
    return done.where("outcome = 'typed'").groupBy("file_name", "field_path").agg(F.sum("n").alias("n"))


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records in one consistent table, with what did not fit as JSON."""
    return drift.consistent(table(spark, folder, "drift_records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_normalised, p3_found, p3_rejected, p3_loaded, p5_found, p5_entries, p5_parts, p6_found, p6_outcomes, p6_table)}

_ENTRIES = """(SELECT line_id, unnest(payload.replacement_history) AS h, generate_subscripts(payload.replacement_history, 1) AS i FROM rollout_lines)"""
_DEEP = f"""SELECT 'rollout_lines' AS table_name, line_id AS record_id, CAST(i - 1 AS INTEGER) AS entry_pos, CAST(j - 1 AS INTEGER) AS part_pos, q
FROM (SELECT line_id, i, unnest(h.content) AS q, generate_subscripts(h.content, 1) AS j FROM {_ENTRIES} WHERE h IS NOT NULL) WHERE q IS NOT NULL"""
_FLAT = """SELECT 'response_items' AS table_name, item_id AS record_id, 0 AS entry_pos, CAST(j - 1 AS INTEGER) AS part_pos, q
FROM (SELECT item_id, unnest(payload.content) AS q, generate_subscripts(payload.content, 1) AS j FROM response_items) WHERE q IS NOT NULL"""

_JSON_TYPES = {"string": "= 'VARCHAR'", "array": "= 'ARRAY'", "number": "IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE')"}
_TYPED = " UNION ALL ".join(
    f"SELECT file_name, '{p}' AS field_path FROM j WHERE json_type(r, '$.{p}') {_JSON_TYPES[k]}" for p, k in drift.TARGET.items()
)

# one field of a raw line: enclosed with doubled quotes, or free of quotes, line breaks and the separator
_D = "'[' || chr(92) || coalesce(nullif(delim, ''), ',') || ']'"
_FIELD = f"""'("(?:[^"]|"")*"|[^"' || chr(13) || chr(10) || chr(92) || coalesce(nullif(delim, ''), ',') || ']*)'"""
_SEVEN = f"'^' || {_FIELD} || repeat({_D} || {_FIELD}, 6) || '$'"
_SOUND = f"'^' || {_FIELD} || '(?:' || {_D} || {_FIELD} || ')*$'"
_AT = lambda k: f"CASE WHEN starts_with(x[{k}], '\"') THEN replace(x[{k}][2:-2], '\"\"', '\"') ELSE x[{k}] END"
_TIME = r"^(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
_RAW = f"""r AS (SELECT raw_id, file_name, coalesce(raw_line, '') AS line, {_SOUND} AS sound, {_SEVEN} AS seven FROM raw_items),
m AS (SELECT raw_id, file_name, regexp_matches(line, sound) AS is_sound, regexp_matches(line, seven) AS is_seven, [{", ".join(f"regexp_extract(line, seven, {k})" for k in range(1, 8))}] AS x FROM r),
f AS (SELECT raw_id, file_name, is_sound, is_seven, {", ".join(f"{_AT(k)} AS f{k}" for k in range(1, 8))} FROM m),
v AS (SELECT *, regexp_full_match(f1, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AND regexp_matches(f2, '{_TIME}') AND try_cast(left(f2, 10) AS DATE) IS NOT NULL AND left(f2, 4) <> '0000' AND f3 IN ('response_item', 'event_msg')
AND f4 IN ('user', 'assistant', 'system', 'developer') AND f5 IN ('input_text', 'output_text') AND regexp_full_match(f6, '[0-9]{{1,9}}') AND regexp_matches(f7, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]') AND NOT regexp_matches(f7, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') AS fits FROM f)"""

SQL = {
    "p3_found": f"WITH {_RAW} SELECT raw_id, CASE WHEN NOT is_sound THEN 'quoting' WHEN NOT is_seven THEN 'column_count' ELSE 'value' END AS reason FROM v WHERE NOT (is_sound AND is_seven AND fits)",
    "p3_loaded": f"""WITH {_RAW} SELECT raw_id, file_name, f1 AS session_id, epoch_us(CAST(f2 AS TIMESTAMPTZ)) AS utc_us, f3 AS type, f4 AS role, f5 AS content_type, CAST(f6 AS BIGINT) AS n_chars, f7 AS text FROM v WHERE is_sound AND is_seven AND fits""",
    "p6_outcomes": f"WITH j AS (SELECT file_name, CAST(raw_json AS JSON) AS r FROM drift_records WHERE json_valid(raw_json)) SELECT file_name, field_path, count(*) AS n FROM ({_TYPED}) GROUP BY ALL",
    "p5_found": f"SELECT table_name, record_id, entry_pos, part_pos FROM ({_DEEP} UNION ALL {_FLAT})",
    "p5_entries": f"SELECT line_id, CAST(i - 1 AS INTEGER) AS entry_pos, h.type AS type, h.role AS role FROM {_ENTRIES} WHERE h IS NOT NULL",
    "p5_parts": f"SELECT table_name, record_id, entry_pos, part_pos, q.type AS type, q.text AS text FROM ({_DEEP} UNION ALL {_FLAT})",
}
