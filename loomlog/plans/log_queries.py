"""Queries over the event log: records, turns, selections, order-sensitive operators, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.functions import text as X
from loomlog.functions import times as T
from loomlog.operators import records as R
from loomlog.operators import sequences as Q
from loomlog.sources.tables import table

def is_prompt() -> Column:
    return (F.col("kind") == "message") & (F.col("role") == "user")


def is_reply() -> Column:
    return (F.col("kind") == "message") & (F.col("role") == "assistant")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return R.records(table(spark, folder, "rollout_lines"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_turns(_records(spark, folder))


def _sum(value: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("bigint")


def record_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its class, source type and keys."""
    return _records(spark, folder).select("session_id", "line_no", "kind", "role", "source_type", "text", "command_key", "output_key")


def turn_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of prompt and response of each turn; turn 0 is what precedes the first prompt."""
    reply = F.col("role") != "user"
    sizes = {"tokens": X.tokens("text"), "lines": X.lines("text"), "edited": X.cards("text", "Edited file"), "created": X.cards("text", "Created file")}
    # texts are measured before the turns are counted, so only sizes and previews of prompts are written and shuffled
    rows = _records(spark, folder).select("session_id", "line_no", "kind", "role", "timestamp", *(c.alias(n) for n, c in sizes.items()), F.when(is_prompt(), X.preview("text")).alias("preview"))
    return (
        R.with_turns(rows)
        .groupBy("session_id", "turn_no")
        .agg(
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
            _sum(F.col("tokens"), is_prompt()).alias("prompt_tokens"),
            _sum(F.col("lines"), is_prompt()).alias("prompt_lines"),
            _sum(F.col("tokens"), reply).alias("response_tokens"),
            _sum(F.col("lines"), reply).alias("response_lines"),
            F.count_if(reply).alias("response_records"),
            F.count_if(F.col("kind") == "action").alias("actions"),
            _sum(F.col("edited"), reply).alias("edited"),
            _sum(F.col("created"), reply).alias("created"),
            F.max_by("timestamp", F.when(reply & (F.coalesce("timestamp", F.lit("")) != ""), F.col("line_no"))).alias("last_timestamp"),
            F.min_by("preview", F.when(is_prompt(), F.col("line_no"))).alias("preview"),
        )
    )


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each session with its first and last timestamp in line order."""
    stamped = F.coalesce(F.col("timestamp"), F.lit("")) != ""
    return (
        _records(spark, folder)
        .groupBy("session_id")
        .agg(
            F.count("*").alias("records"),
            F.count_if(is_prompt()).alias("prompts"),
            F.count_if(is_reply()).alias("replies"),
            F.count_if(F.col("kind") == "action").alias("actions"),
            F.min_by("timestamp", F.when(stamped, F.col("line_no"))).alias("first_timestamp"),
            F.max_by("timestamp", F.when(stamped, F.col("line_no"))).alias("last_timestamp"),
            F.sum(X.truncation_markers("text")).alias("truncation_markers"),
            F.sum(X.truncated_tokens("text")).alias("truncated_tokens"),
            F.sum(F.regexp_count("text", F.lit("(?m)^Edited file$"))).cast("bigint").alias("edited"),
            F.sum(F.regexp_count("text", F.lit("(?m)^Created file$"))).cast("bigint").alias("created"),
        )
    )


def message_list(spark: SparkSession, folder: str) -> DataFrame:
    """Messages numbered within their session, with previews."""
    rows = _records(spark, folder).where("kind = 'message'")
    return Q.numbered(rows, ["session_id"], "line_no", "message_no").select("session_id", "message_no", "line_no", "role", X.preview("text").alias("preview"))


def response_list(spark: SparkSession, folder: str) -> DataFrame:
    """What answers each prompt."""
    rows = _turns(spark, folder).where("turn_no > 0 and role <> 'user'")
    return rows.groupBy("session_id", "turn_no").agg(
        F.count("*").alias("records"),
        _sum(F.length("text"), is_reply()).alias("assistant_chars"),
        F.sum(X.lines("text")).alias("lines"),
        F.sum(X.tokens("text")).alias("tokens"),
        F.count_if(F.col("kind") == "action").alias("actions"),
        F.sum(X.cards("text", "Edited file")).alias("edited"),
        F.sum(X.cards("text", "Created file")).alias("created"),
        F.min_by("text", F.when(is_reply(), F.col("line_no"))).alias("first_reply"),
    )


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return R.classified(table(spark, folder, "rollout_lines"))


def event_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Events by key: those that give a record, those passed over for a known reason, and unknown ones."""
    return _classified(spark, folder).groupBy("status", "event").agg(F.count("*").alias("n"))


def ignored_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of the events that give no record."""
    return _classified(spark, folder).where("status <> 'recognized'").groupBy("reason").agg(F.count("*").alias("n"))


def unknown_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of unrecognised schemas, whole, for a side file."""
    return _classified(spark, folder).where("status = 'unknown'").select("line_id", "session_id", "line_no", "event")


def mode_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Messages only."""
    return _records(spark, folder).where("kind = 'message'").select("session_id", "line_no", "role", "text")


def mode_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Tool actions only."""
    return _records(spark, folder).where("kind = 'action'").select("session_id", "line_no", "text")


def message_range(spark: SparkSession, folder: str) -> DataFrame:
    """Messages 2 to 4 of each session."""
    return message_list(spark, folder).where("message_no between 2 and 4")


def turn_n(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the second turn of each session."""
    return _turns(spark, folder).where("turn_no = 2").select("session_id", "line_no", "kind", "role", "text")


def last_assistant(spark: SparkSession, folder: str) -> DataFrame:
    """Last assistant message of each session."""
    rows = _records(spark, folder).where(is_reply())
    return rows.groupBy("session_id").agg(F.max("line_no").alias("line_no"), F.max_by("text", "line_no").alias("text"))


def last_substantial(spark: SparkSession, folder: str) -> DataFrame:
    """Last assistant message of at least 200 characters, else the last one."""
    order = F.struct((F.length("text") >= 200).alias("big"), F.col("line_no"))
    rows = _records(spark, folder).where(is_reply())
    return rows.groupBy("session_id").agg(F.max_by("line_no", order).alias("line_no"), F.max_by("text", order).alias("text"))


def _last(spark: SparkSession, folder: str, n: int, preamble: bool) -> DataFrame:
    rows = _turns(spark, folder)
    most = rows.groupBy(F.col("session_id").alias("s")).agg(F.max("turn_no").alias("turns"))
    kept = (F.col("turn_no") > F.col("turns") - n) & ((F.col("turn_no") > 0) | F.lit(preamble))
    return rows.join(most, F.col("session_id").eqNullSafe(F.col("s"))).where(kept).select("session_id", "turn_no", "line_no", "kind", "role")


def last_response(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that answers the last prompt of each session."""
    return _last(spark, folder, 1, False).where("role <> 'user'")


def last_n_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Last two turns; sessions with fewer are kept whole, with what precedes their first prompt."""
    return _last(spark, folder, 2, True)


def last_n_turns_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Last two turns, without what precedes the first prompt."""
    return _last(spark, folder, 2, False)


def since_text(spark: SparkSession, folder: str) -> DataFrame:
    """Records from the first prompt on that contains a phrase, whatever its case and spacing."""
    rows = _turns(spark, folder)
    hit = rows.where(is_prompt() & X.search_key("text").contains("archive writer"))
    start = hit.groupBy(F.col("session_id").alias("s")).agg(F.min("turn_no").alias("start_turn"))
    return rows.join(start, F.col("session_id").eqNullSafe(F.col("s"))).where("turn_no >= start_turn").select("session_id", "turn_no", "line_no", "role")


def since_time(spark: SparkSession, folder: str) -> DataFrame:
    """Records from the first prompt on, in line order, whose offset-aware time is 2025-07-01 or later; wall times never are."""
    rows = _turns(spark, folder)
    hit = rows.where(is_prompt() & (T.parsed("timestamp") >= T.since("2025-07-01")))
    start = hit.groupBy(F.col("session_id").alias("s")).agg(F.min("turn_no").alias("start_turn"))
    return rows.join(start, F.col("session_id").eqNullSafe(F.col("s"))).where("turn_no >= start_turn").select("session_id", "turn_no", "line_no", "role")


def adjacent_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Records without adjacent repetitions."""
    return Q.without_adjacent_repeats(_records(spark, folder)).select("session_id", "line_no", "kind", "role")


def action_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Contiguous runs of actions with their summary line."""
    return Q.action_blocks(_records(spark, folder))


def fifo_pairing(spark: SparkSession, folder: str) -> DataFrame:
    """Commands with the outputs that answer them, first in first out."""
    return Q.paired(_records(spark, folder))


def lookback_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Commands and outputs kept after dropping repeats of the last 12 commands and 3 outputs."""
    return Q.without_recent_repeats(_records(spark, folder))


def asof_context(spark: SparkSession, folder: str) -> DataFrame:
    """For each prompt the last turn context before it."""
    return Q.asof(R.events(table(spark, folder, "rollout_lines")), F.col("type") == "turn_context", F.col("payload.type") == "user_message")


def interval_history(spark: SparkSession, folder: str) -> DataFrame:
    """Compactions and rollbacks inside each turn."""
    events = R.events(table(spark, folder, "rollout_lines"))
    return Q.history_in_turns(events)


def live_context(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose records are still in the context after all compactions and rollbacks."""
    return Q.live_lines(table(spark, folder, "rollout_lines"))


def byte_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Byte range of each record's text in the text of its session."""
    return Q.byte_ranges(_records(spark, folder))


def tool_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Exit code and body of each tool output, transport header removed."""
    events = R.events(table(spark, folder, "rollout_lines")).where("payload.item.type = 'local_shell_call_output'")
    rows = events.select("session_id", "line_no", F.col("payload.item.output").alias("output"))
    return rows.select("session_id", "line_no", X.exit_code("output").alias("exit_code"), X.without_transport_header("output").alias("body"))


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each changed file of each change event."""
    events = R.events(table(spark, folder, "rollout_lines")).where("payload.item.type = 'FileChange'")
    rows = events.select("session_id", "line_no", F.col("payload.item.status").alias("status"), F.explode("payload.item.changes").alias("path", "change"))
    return rows.select("session_id", "line_no", "status", "path", F.col("change.type").alias("operation"))


def truncation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that state omitted tokens."""
    rows = R.events(table(spark, folder, "rollout_lines")).select("session_id", "line_no", F.col("payload.message").alias("text"))
    return rows.select("session_id", "line_no", X.truncation_markers("text").alias("markers"), X.truncated_tokens("text").alias("tokens")).where("markers > 0")


_NAMES = """record_list turn_metrics session_summary message_list response_list event_audit ignored_reasons unknown_sidecar mode_chat
mode_actions message_range turn_n last_assistant last_substantial last_response last_n_turns last_n_turns_indexed since_text since_time
adjacent_dedup action_blocks fifo_pairing lookback_dedup asof_context interval_history live_context byte_provenance tool_outputs file_changes truncation_report""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

_EV = "ev AS (SELECT * FROM rollout_lines QUALIFY row_number() OVER (PARTITION BY session_id, line_no ORDER BY line_id) = 1)"
_P, _I = "coalesce(payload.type, '')", "coalesce(payload.item.type, '')"
_KEY = "concat_ws('/', coalesce(nullif(type, ''), '-'), coalesce(nullif(payload.type, ''), '-'), coalesce(nullif(payload.item.type, ''), '-'))"
_BLOB = f"lower(concat_ws(' ', coalesce(type, ''), {_P}, {_I}))"
_NOISY = " OR ".join(f"contains({_BLOB}, '{h}')" for h in R.NOISE)
_CMD = "CASE WHEN json_valid(payload.item.arguments) THEN json_extract_string(payload.item.arguments, '$.cmd') END"
_HEADER = r"'^(?:(?:Chunk ID|Wall time|Process exited with code|Original token count)[^\n]*\n){0,7}Output:\n?'"
_OUT = f"regexp_replace(payload.item.output, {_HEADER}, '')"
_CARDS = """array_to_string(list_transform(map_entries(payload.item.changes), lambda c: CASE c.value.type WHEN 'add' THEN 'Created file' WHEN 'delete' THEN 'Deleted file' ELSE 'Edited file' END || chr(10) || c.key), chr(10) || chr(10))"""
_PARTS = "array_to_string(list_transform(payload.item.content, lambda c: c.text), chr(10))"
_REC = f"""{_EV}, r0 AS (SELECT session_id, line_no, line_id, source, timestamp, {_KEY} AS source_type,
CASE WHEN {_P} = 'item_completed' AND lower({_I}) IN ('usermessage', 'agentmessage') THEN 'message' WHEN {_P} = 'item_completed' AND lower({_I}) = 'filechange' THEN 'action'
 WHEN {_NOISY} THEN NULL WHEN {_I} IN ('local_shell_call', 'local_shell_call_output') THEN 'action' WHEN {_P} IN ('user_message', 'agent_message', 'assistant_message') THEN 'message' END AS kind,
CASE WHEN {_P} = 'item_completed' AND lower({_I}) = 'usermessage' THEN 'user' WHEN {_P} = 'item_completed' AND lower({_I}) = 'agentmessage' THEN 'assistant' WHEN {_P} = 'item_completed' AND lower({_I}) = 'filechange' THEN 'tool'
 WHEN {_I} IN ('local_shell_call', 'local_shell_call_output') THEN 'tool' WHEN {_P} = 'user_message' THEN 'user' ELSE 'assistant' END AS role,
CASE WHEN {_P} = 'item_completed' AND lower({_I}) IN ('usermessage', 'agentmessage') THEN {_PARTS}
 WHEN {_P} = 'item_completed' AND lower({_I}) = 'filechange' THEN concat_ws(chr(10) || chr(10), 'Status: ' || payload.item.status, nullif({_CARDS}, ''))
 WHEN {_I} = 'local_shell_call' THEN 'Ran ' || {_CMD} WHEN {_I} = 'local_shell_call_output' THEN {_OUT} ELSE payload.message END AS text,
CASE WHEN {_I} = 'local_shell_call' THEN lower(trim(regexp_replace({_CMD}, '\\s+', ' ', 'g'))) END AS command_key,
CASE WHEN {_I} = 'local_shell_call_output' THEN sha256({_OUT}) END AS output_key FROM ev),
rec AS (SELECT * FROM r0 WHERE kind IS NOT NULL AND text IS NOT NULL AND regexp_matches(text, '[^\\s]'))"""
_TURN = f"{_REC}, t AS (SELECT *, CAST(sum(CASE WHEN kind = 'message' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS BIGINT) AS turn_no FROM rec)"
_TOK = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
_LINES = r"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) OR suffix(text, chr(13)) THEN 0 ELSE 1 END END"
_USER, _BOT = "kind = 'message' AND role = 'user'", "kind = 'message' AND role = 'assistant'"
_MARK = r"'(?i)…([0-9,]+)\s+tokens truncated…'"
_MARKERS = f"len(regexp_extract_all(text, {_MARK}))"
_MTOK = f"coalesce(list_sum(list_transform(regexp_extract_all(text, {_MARK}, 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))), 0)"


def _cards(verb: str) -> str:
    return f"len(regexp_extract_all(text, '(?m)^{verb} file$'))"


def _preview(limit: int) -> str:
    one = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({one}) > {limit} THEN rtrim(substring({one}, 1, {limit - 1})) || '…' ELSE {one} END"


_MSG = f"{_REC}, m AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS message_no, line_no, role, {_preview(120)} AS preview FROM rec WHERE kind = 'message')"
_LAST = f"{_TURN}, l AS (SELECT *, max(turn_no) OVER (PARTITION BY session_id) AS turns FROM t)"
_SEARCH = r"replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')"
_REASON = f"""CASE WHEN coalesce(type, '') = 'response_item' AND k = 'additional_tools' THEN 'tool_catalog_metadata' WHEN type = 'token_usage_record' OR k = 'token_count' THEN 'telemetry_token_count'
WHEN k = 'agent_reasoning' THEN 'raw_reasoning_not_exported' WHEN k = 'reasoning' THEN 'reasoning_summary_opt_in_disabled' WHEN type = 'event_msg' AND p = 'item_completed' AND k = 'contextcompaction' THEN 'context_history_event'
WHEN type IN ('turn_context', 'session_meta', 'world_state') THEN 'metadata_only' WHEN type = 'compacted' OR k IN ('context_compacted', 'thread_rolled_back') THEN 'context_history_event'
WHEN k IN ({", ".join(f"'{x}'" for x in R.LIFECYCLE)}) THEN 'lifecycle_event' WHEN k IN ({", ".join(f"'{x}'" for x in R.SPECIAL)}) THEN 'unsupported_tool_lifecycle_or_specialized_event'
WHEN type = 'response_item' AND k IN ({", ".join(f"'{x}'" for x in R.KNOWN_ITEMS)}) THEN 'known_response_item_not_rendered_or_duplicate' WHEN type = 'event_msg' AND k = 'error' THEN 'runtime_error_event' ELSE 'unrecognized_schema' END"""
_IGN = f"""{_REC}, ign AS (SELECT *, {_KEY} AS event, {_P} AS p, lower(CASE WHEN {_P} IN ('item_completed', 'item_started', 'item_updated') THEN {_I} ELSE {_P} END) AS k FROM ev WHERE line_id NOT IN (SELECT line_id FROM rec))"""
_SEG = f"""{_REC}, f AS (SELECT *, (kind = 'action' AND command_key IS NOT NULL) AS is_cmd, (kind = 'action' AND output_key IS NOT NULL) AS is_out FROM rec),
s AS (SELECT *, sum(CASE WHEN is_cmd OR is_out THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY line_no) AS seg FROM f),
q AS (SELECT *, sum(CASE WHEN is_cmd THEN 1 ELSE -1 END) OVER (PARTITION BY session_id, seg ORDER BY line_no) AS level FROM s WHERE is_cmd OR is_out),
w AS (SELECT *, min(level) OVER (PARTITION BY session_id, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM q),
a AS (SELECT *, is_cmd OR level >= least(coalesce(low, 0), 0) AS admitted FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, seg, is_cmd ORDER BY line_no) AS k FROM a WHERE admitted)"""
_CTX = f"{_EV}, h AS (SELECT session_id, line_no, type, payload, sum(CASE WHEN payload.type = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS turn_no FROM ev)"

_WALLED = r"replace(trim(timestamp), ',', '.')"
_DT = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
_AWARE = rf"CASE WHEN regexp_matches({_WALLED}, '^{_DT}(?:[Zz]|[+-]\d{{2}}(?::?\d{{2}})?)$') THEN try_cast(regexp_replace(regexp_replace(upper({_WALLED}), '([+-]\d{{2}})(\d{{2}})$', '\1:\2'), '(\.\d{{6}})\d+', '\1') AS TIMESTAMPTZ) END"
_UNIX = rf"CASE WHEN regexp_matches(trim(timestamp), '^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$') AND try_cast(trim(timestamp) AS DOUBLE) BETWEEN -62135596800 AND 253402300799.99 THEN CAST(trunc(try_cast(trim(timestamp) AS DOUBLE) * 1000000) AS BIGINT) END"
_WALL = rf"CASE WHEN regexp_matches({_WALLED}, '^{_DT}$') THEN try_cast(regexp_replace({_WALLED}, '(\.\d{{6}})\d+', '\1') AS TIMESTAMP) END"

SQL = {
    "record_list": f"WITH {_REC} SELECT session_id, line_no, kind, role, source_type, text, command_key, output_key FROM rec",
    "turn_metrics": f"""WITH {_TURN} SELECT session_id, turn_no, min(line_no) AS first_line, max(line_no) AS last_line,
CAST(coalesce(sum({_TOK}) FILTER ({_USER}), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum({_LINES}) FILTER ({_USER}), 0) AS BIGINT) AS prompt_lines,
CAST(coalesce(sum({_TOK}) FILTER (role <> 'user'), 0) AS BIGINT) AS response_tokens, CAST(coalesce(sum({_LINES}) FILTER (role <> 'user'), 0) AS BIGINT) AS response_lines,
count(*) FILTER (role <> 'user') AS response_records, count(*) FILTER (kind = 'action') AS actions,
CAST(coalesce(sum({_cards('Edited')}) FILTER (role <> 'user'), 0) AS BIGINT) AS edited, CAST(coalesce(sum({_cards('Created')}) FILTER (role <> 'user'), 0) AS BIGINT) AS created,
arg_max(timestamp, line_no) FILTER (role <> 'user' AND coalesce(timestamp, '') <> '') AS last_timestamp, arg_min({_preview(120)}, line_no) FILTER ({_USER}) AS preview FROM t GROUP BY ALL""",
    "session_summary": f"""WITH {_REC} SELECT session_id, count(*) AS records, count(*) FILTER ({_USER}) AS prompts, count(*) FILTER ({_BOT}) AS replies, count(*) FILTER (kind = 'action') AS actions,
arg_min(timestamp, line_no) FILTER (coalesce(timestamp, '') <> '') AS first_timestamp, arg_max(timestamp, line_no) FILTER (coalesce(timestamp, '') <> '') AS last_timestamp,
CAST(sum({_MARKERS}) AS BIGINT) AS truncation_markers, CAST(sum({_MTOK}) AS BIGINT) AS truncated_tokens,
CAST(sum(len(regexp_extract_all(text, '(?m)^Edited file$'))) AS BIGINT) AS edited, CAST(sum(len(regexp_extract_all(text, '(?m)^Created file$'))) AS BIGINT) AS created FROM rec GROUP BY session_id""",
    "message_list": f"WITH {_MSG} SELECT * FROM m",
    "response_list": f"""WITH {_TURN} SELECT session_id, turn_no, count(*) AS records, CAST(coalesce(sum(length(text)) FILTER ({_BOT}), 0) AS BIGINT) AS assistant_chars, CAST(sum({_LINES}) AS BIGINT) AS lines,
CAST(sum({_TOK}) AS BIGINT) AS tokens, count(*) FILTER (kind = 'action') AS actions, CAST(sum({_cards('Edited')}) AS BIGINT) AS edited, CAST(sum({_cards('Created')}) AS BIGINT) AS created, arg_min(text, line_no) FILTER ({_BOT}) AS first_reply FROM t WHERE turn_no > 0 AND role <> 'user' GROUP BY ALL""",
    "event_audit": f"""WITH {_IGN} SELECT 'recognized' AS status, source_type AS event, count(*) AS n FROM rec GROUP BY ALL
UNION ALL SELECT CASE WHEN {_REASON} = 'unrecognized_schema' THEN 'unknown' ELSE 'ignored' END, event, count(*) FROM ign GROUP BY ALL""",
    "ignored_reasons": f"WITH {_IGN} SELECT {_REASON} AS reason, count(*) AS n FROM ign GROUP BY ALL",
    "unknown_sidecar": f"WITH {_IGN} SELECT line_id, session_id, line_no, event FROM ign WHERE {_REASON} = 'unrecognized_schema'",
    "mode_chat": f"WITH {_REC} SELECT session_id, line_no, role, text FROM rec WHERE kind = 'message'",
    "mode_actions": f"WITH {_REC} SELECT session_id, line_no, text FROM rec WHERE kind = 'action'",
    "message_range": f"WITH {_MSG} SELECT * FROM m WHERE message_no BETWEEN 2 AND 4",
    "turn_n": f"WITH {_TURN} SELECT session_id, line_no, kind, role, text FROM t WHERE turn_no = 2",
    "last_assistant": f"WITH {_REC} SELECT session_id, max(line_no) AS line_no, arg_max(text, line_no) AS text FROM rec WHERE {_BOT} GROUP BY session_id",
    "last_substantial": f"WITH {_REC} SELECT session_id, line_no, text FROM rec WHERE {_BOT} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY length(text) >= 200 DESC, line_no DESC) = 1",
    "last_response": f"WITH {_LAST} SELECT session_id, turn_no, line_no, kind, role FROM l WHERE turn_no > turns - 1 AND turn_no > 0 AND role <> 'user'",
    "last_n_turns": f"WITH {_LAST} SELECT session_id, turn_no, line_no, kind, role FROM l WHERE turn_no > turns - 2",
    "last_n_turns_indexed": f"WITH {_LAST} SELECT session_id, turn_no, line_no, kind, role FROM l WHERE turn_no > turns - 2 AND turn_no > 0",
    "since_text": f"WITH {_TURN} SELECT session_id, turn_no, line_no, role FROM t JOIN (SELECT session_id, min(turn_no) AS start_turn FROM t WHERE {_USER} AND contains({_SEARCH}, 'archive writer') GROUP BY session_id) USING (session_id) WHERE turn_no >= start_turn",
    "since_time": f"""WITH {_TURN} SELECT session_id, turn_no, line_no, role FROM t JOIN (SELECT session_id, min(turn_no) AS start_turn FROM t WHERE {_USER}
AND coalesce(epoch_us({_AWARE}), {_UNIX}) >= epoch_us(TIMESTAMP '2025-07-01') GROUP BY session_id) USING (session_id) WHERE turn_no >= start_turn""",
    "adjacent_dedup": f"""WITH {_REC}, b AS (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind OR lag(role) OVER w IS DISTINCT FROM role OR lag(text) OVER w IS DISTINCT FROM text AS fresh FROM rec WINDOW w AS (PARTITION BY session_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS island FROM b)
SELECT session_id, line_no, kind, role FROM (SELECT *, first_value(source_type) OVER (PARTITION BY session_id, island ORDER BY line_no) AS first_type FROM i) WHERE fresh OR ({_USER} AND source_type = first_type)""",
    "action_blocks": f"""WITH {_REC}, b AS (SELECT *, sum(CASE WHEN kind = 'action' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY line_no) AS island FROM rec),
c AS (SELECT session_id, min(line_no) AS first_line, count(*) AS actions, count(*) FILTER (command_key IS NOT NULL OR starts_with(text, 'Ran ')) AS commands,
CAST(sum(len(regexp_extract_all(text, '(?m)^Created file$'))) AS BIGINT) AS created, CAST(sum(len(regexp_extract_all(text, '(?m)^Edited file$'))) AS BIGINT) AS edited, CAST(sum(len(regexp_extract_all(text, '(?m)^Deleted file$'))) AS BIGINT) AS deleted
FROM b WHERE kind = 'action' GROUP BY session_id, island)
SELECT *, CASE WHEN created + edited + deleted = 0 AND commands > 0 THEN 'Ran ' || commands || ' command' || CASE WHEN commands = 1 THEN '' ELSE 's' END ELSE concat_ws(', ',
CASE WHEN created > 0 THEN 'Created ' || created || ' file' || CASE WHEN created = 1 THEN '' ELSE 's' END END, CASE WHEN edited > 0 THEN 'Edited ' || edited || ' file' || CASE WHEN edited = 1 THEN '' ELSE 's' END END,
CASE WHEN deleted > 0 THEN 'Deleted ' || deleted || ' file' || CASE WHEN deleted = 1 THEN '' ELSE 's' END END, CASE WHEN commands > 0 THEN 'ran ' || commands || ' command' || CASE WHEN commands = 1 THEN '' ELSE 's' END END) END AS summary FROM c""",
    "fifo_pairing": f"WITH {_SEG} SELECT c.session_id, c.line_no AS command_line, o.line_no AS output_line, c.command_key, o.output_key FROM n c LEFT JOIN n o ON o.session_id = c.session_id AND o.seg = c.seg AND o.k = c.k AND o.is_out WHERE c.is_cmd",
    "lookback_dedup": f"""WITH RECURSIVE {_REC}, k AS (SELECT session_id, line_no, command_key, output_key, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM rec WHERE command_key IS NOT NULL OR output_key IS NOT NULL),
f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS line_no, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS os, false AS kept FROM k
UNION ALL SELECT k.session_id, k.n, k.line_no, CASE WHEN command_key IS NOT NULL AND NOT list_contains(cs, command_key) THEN list_append(cs, command_key)[-12:] ELSE cs END,
CASE WHEN output_key IS NOT NULL AND NOT (command_key IS NOT NULL AND list_contains(cs, command_key)) AND NOT list_contains(os, output_key) THEN list_append(os, output_key)[-3:] ELSE os END,
NOT coalesce(list_contains(cs, command_key), false) AND NOT coalesce(list_contains(os, output_key), false) FROM f JOIN k ON k.session_id = f.session_id AND k.n = f.n + 1)
SELECT session_id, line_no FROM f WHERE kept""",
    "live_context": f"""WITH RECURSIVE {_EV}, k AS (SELECT session_id, line_no, {_P} AS p, type = 'compacted' AND len(coalesce(payload.replacement_history, [])) > 0 AS compacts, coalesce(payload.num_turns, 0) AS turns,
{_P} IN ('user_message', 'agent_message', 'assistant_message') OR {_I} IN ('local_shell_call', 'local_shell_call_output', 'FileChange') AS record, list_transform(list_filter(coalesce(payload.replacement_history, []),
lambda h: h.role = 'user' AND len(list_filter(coalesce(h.content, []), lambda c: regexp_matches(c.text, '\\S'))) > 0), lambda h: {{'n': CAST(NULL AS BIGINT), 'u': true}}) AS asked, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM ev),
f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(n BIGINT, u BOOLEAN)[]) AS live, CAST(NULL AS BIGINT) AS head FROM k
UNION ALL SELECT k.session_id, k.n, CASE WHEN compacts THEN list_concat([{{'n': k.line_no, 'u': false}}], asked) WHEN p = 'thread_rolled_back' AND turns > 0 THEN
 CASE WHEN len(list_filter(live, lambda x: x.u)) >= turns THEN live[:list_filter(range(1, len(live) + 1), lambda i: live[i].u)[-turns] - 1] ELSE [] END
 WHEN record THEN list_append(live, {{'n': k.line_no, 'u': p = 'user_message'}}) ELSE live END, CASE WHEN compacts THEN k.line_no ELSE f.head END FROM f JOIN k ON k.session_id = f.session_id AND k.n = f.n + 1),
l AS (SELECT session_id, live, head FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1),
e AS (SELECT session_id, head, len(list_filter(live, lambda x: x.u AND x.n IS NULL)) AS asked, unnest(live) AS x FROM l)
SELECT session_id, x.n AS line_no, CAST(CASE WHEN x.n = head THEN asked END AS BIGINT) AS history_prompts FROM e WHERE x.n IS NOT NULL""",
    "asof_context": f"WITH {_CTX} SELECT session_id, line_no, context_line FROM (SELECT *, max(CASE WHEN type = 'turn_context' THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_line FROM h) WHERE payload.type = 'user_message'",
    "interval_history": f"WITH {_CTX} SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, count(*) FILTER (type = 'compacted') AS compactions, count(*) FILTER (payload.type = 'thread_rolled_back') AS rollbacks FROM h WHERE type = 'compacted' OR payload.type = 'thread_rolled_back' GROUP BY ALL",
    "byte_provenance": f"WITH {_REC} SELECT session_id, line_no, CAST(sum(strlen(text)) OVER (PARTITION BY session_id ORDER BY line_no) - strlen(text) AS BIGINT) AS byte_start, CAST(sum(strlen(text)) OVER (PARTITION BY session_id ORDER BY line_no) AS BIGINT) AS byte_end FROM rec",
    "tool_outputs": f"""WITH {_EV} SELECT session_id, line_no, try_cast(nullif(regexp_extract(payload.item.output, '^(?:(?:Chunk ID|Wall time|Original token count)[^\\n]*\\n){{0,7}}Process exited with code (-?\\d+)', 1), '') AS INTEGER) AS exit_code, {_OUT} AS body FROM ev WHERE payload.item.type = 'local_shell_call_output'""",
    "file_changes": f"WITH {_EV} SELECT session_id, line_no, status, c.key AS path, c.value.type AS operation FROM (SELECT session_id, line_no, payload.item.status AS status, unnest(map_entries(payload.item.changes)) AS c FROM ev WHERE payload.item.type = 'FileChange')",
    "truncation_report": f"WITH {_EV}, x AS (SELECT session_id, line_no, payload.message AS text FROM ev) SELECT session_id, line_no, CAST({_MARKERS} AS BIGINT) AS markers, CAST({_MTOK} AS BIGINT) AS tokens FROM x WHERE {_MARKERS} > 0",
}
