"""Queries over events as raw JSON lines: classification, user signals, the turn index, post-processing, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions import extract as E
from loomlog.operators import classify as K
from loomlog.operators import lineage as L
from loomlog.operators import postprocess as P
from loomlog.operators import records as R
from loomlog.operators import texts as TX
from loomlog.operators import turns as T
from loomlog.sources.tables import table


def rollout_json(spark: SparkSession, folder: str) -> DataFrame:
    """The newer log as JSON lines: session_id, line_no, raw."""
    return K.as_json(R.events(table(spark, folder, "rollout_lines")), F.col("session_id"), F.col("line_no"))


def legacy_json(spark: SparkSession, folder: str) -> DataFrame:
    """The older log as JSON lines; its rows are numbered by item_id."""
    return K.as_json(table(spark, folder, "response_items"), F.col("session_id"), F.col("item_id").alias("line_no"))


def _both(spark: SparkSession, folder: str) -> DataFrame:
    named = lambda df, name: df.withColumn("table_name", F.lit(name))
    return named(K.classify(rollout_json(spark, folder)), "rollout_lines").unionByName(named(K.classify(legacy_json(spark, folder)), "response_items"))


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """The record of every event of both logs: class, cleaned text or action card, keys."""
    rows = _both(spark, folder).where("status = 'recognized'")
    return rows.select("table_name", "session_id", "line_no", "kind", "role", "source_type", F.sha2("text", 256).alias("text_sha256"), "command_key", "output_key")


def event_status(spark: SparkSession, folder: str) -> DataFrame:
    """Events of both logs by status, key and reason."""
    return _both(spark, folder).groupBy("table_name", "status", "event", "reason").agg(F.count("*").alias("n"))


def user_signals(spark: SparkSession, folder: str) -> DataFrame:
    """What users said: surface, hash of the whole prompt, the turn it names."""
    rows = _both(spark, folder).where("surface is not null")
    return rows.select("table_name", "session_id", "line_no", "surface", "prompt_sha256", F.nullif("turn_id", F.lit("")).alias("turn_id"), "injected")


def turn_index(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with their ids; prompts on several surfaces count once."""
    turns = T.turn_index(K.strict(K.classify(rollout_json(spark, folder), with_text=False)))
    return turns.select("session_id", "turn_no", "line_no", F.nullif("turn_id", F.lit("")).alias("turn_id"), "text_sha256", F.size("duplicate_lines").alias("duplicates"))


def history_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that change the history, and whether they replace it."""
    rows = K.classify(rollout_json(spark, folder), with_text=False).where("history is not null")
    return rows.select("session_id", "line_no", "history", "replaces")


def activity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each session that separate turns, of both logs."""
    return _both(spark, folder).where("activity and surface is null").groupBy("table_name", "session_id").agg(F.count("*").alias("n"))


def parse_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Parse status of each drifted record as it is, cut before its end, and with an invalid escape in every string value."""
    rows = table(spark, folder, "drift_records").select("record_id", "raw_json")
    shape = lambda name, raw: rows.select(F.concat_ws(":", "record_id", F.lit(name)).alias("record_id"), raw.alias("raw_json"))
    raw = F.col("raw_json")
    every = shape("whole", raw).unionByName(shape("cut", F.expr("substring(raw_json, 1, length(raw_json) - 1)"))).unionByName(shape("escape", F.replace(raw, F.lit('":"'), F.lit('":"\\q'))))
    every = every.unionByName(shape("list", F.concat(F.lit("["), raw, F.lit("]")))).unionByName(shape("blank", F.lit("  ")))
    return TX.parse_status(every.select("record_id", "raw_json")).select("record_id", "status", "repairs", "sha256")


def post_processed(spark: SparkSession, folder: str) -> DataFrame:
    """Records after repeat filters, noise filter, pairing of commands with outputs, and block summaries."""
    rows = P.post_processed(K.classify(rollout_json(spark, folder)).where("status = 'recognized'"))
    return rows.select("session_id", "position", "kind", "role", "source_type", "source_lines", F.sha2("text", 256).alias("text_sha256"))


def turn_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """Line and byte ranges of the second and third turn of each session, with the context they need."""
    lines = L.native_lines(R.events(table(spark, folder, "rollout_lines")))
    turns = T.turn_index(K.classify(rollout_json(spark, folder), with_text=False))
    return L.provenance(L.with_context(L.turn_ranges(lines, turns, 2, 3), lines), lines)


def record_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """Line and byte ranges of the lines behind the assistant's messages of each session, with the context they need."""
    lines = L.native_lines(R.events(table(spark, folder, "rollout_lines")))
    records = R.records(table(spark, folder, "rollout_lines")).where("kind = 'message' and role = 'assistant'")
    chosen = records.select("session_id", F.array("line_no").alias("source_lines"))
    return L.provenance(L.with_context(L.line_ranges(lines, chosen), lines), lines)


def range_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of adjacent lines of each session that hold prompts or answers, as ranges."""
    lines = L.native_lines(R.events(table(spark, folder, "rollout_lines")))
    said = R.records(table(spark, folder, "rollout_lines")).where("kind = 'message'").select("session_id", F.array("line_no").alias("source_lines"))
    return L.merged(L.line_ranges(lines, said)).select("session_id", "line_start", "line_end", "byte_start", "byte_end")


def turn_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The turn index of a log in which every prompt comes on a second surface too, right behind the first: the turns stay the same."""
    lines = rollout_json(spark, folder).withColumn("line_no", F.col("line_no") * 2)
    prompts = R.events(table(spark, folder, "rollout_lines")).where("payload.type = 'user_message'")
    part = F.array(F.struct(F.lit("input_text").alias("type"), F.col("payload.message").alias("text")))
    again = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), part.alias("content")).alias("payload")))
    every = lines.unionByName(prompts.select("session_id", (F.col("line_no") * 2 + 1).alias("line_no"), again.alias("raw")))
    turns = T.turn_index(K.classify(every, with_text=False))
    return turns.select("session_id", "turn_no", (F.col("line_no") / 2).cast("bigint").alias("line_no"), F.nullif("turn_id", F.lit("")).alias("turn_id"), F.size("duplicate_lines").alias("duplicates"))


def source_times(spark: SparkSession, folder: str) -> DataFrame:
    """The time that each event states, wherever: here at the top, in the payload, in an item inside it, or nowhere."""
    rows = table(spark, folder, "rollout_lines").select("line_id", "timestamp")
    at = lambda depth: F.pmod("line_id", F.lit(4)) == depth
    item = F.struct(F.when(at(2), F.col("timestamp")).alias("created_at"))
    payload = F.struct(F.when(at(1), F.col("timestamp")).alias("time"), item.alias("item"), F.struct(F.lit("no").alias("timestamp")).alias("data"))
    raw = F.to_json(F.struct(F.when(at(0), F.col("timestamp")).alias("timestamp"), payload.alias("payload")))
    return TX.mapped(rows.select("line_id", raw.alias("raw")), "line_id", "raw", {"stated": "string"}, lambda t: (E.event_time(E.embedded(t)) or None,))


_NAMES = """event_records event_status user_signals turn_index history_events activity_counts parse_audit post_processed turn_excerpt record_excerpt
range_merge turn_merge source_times""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

from loomlog.plans.log_queries import _EV  # noqa: E402

_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _clean(x: str) -> str:
    """Terminal sequences out, line ends alike, stripped, truncation markers written out."""
    for pattern in (TX_OSC, TX_ANSI, TX_CONTROL, r"(?m)^0;[^\n]*(?:\n|$)"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = _strip(rf"regexp_replace({x}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')")
    return rf"regexp_replace({x}, '(?i)…([0-9,]+)\s+tokens truncated…', '[SOURCE TOOL OUTPUT TRUNCATED: \1 tokens omitted; not recoverable from this record]', 'g')"


from loomlog.functions.text import ANSI as TX_ANSI, CONTROL as TX_CONTROL, OSC as TX_OSC  # noqa: E402


def _fence(body: str, lang: str) -> str:
    return f"repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all({body}, '(`+)', 1), lambda t: length(t))), 0))) || {lang} || chr(10) || {_rstrip(body)} || chr(10) || repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all({body}, '(`+)', 1), lambda t: length(t))), 0)))"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACE}+$', '')"


def _guess(x: str) -> str:
    return f"""CASE WHEN {x}[1] IN ('{{', '[') THEN 'json' WHEN starts_with({x}, 'diff --git') OR starts_with({x}, '@@ ') THEN 'diff'
WHEN starts_with({x}, 'import ') OR contains({x}, 'export function ') OR contains({x}, 'const ') THEN 'ts'
WHEN starts_with({x}, '$ ') OR contains({x}, '$ErrorActionPreference') OR contains({x}, 'Get-Content ') OR contains({x}, 'npm run ') THEN 'ps1' ELSE 'text' END"""


_PARTS_CLEAN = f"list_filter(list_transform(list_filter(list_transform(coalesce(payload.content, []), lambda p: CASE WHEN p.type = 'input_image' THEN '[image content part omitted]' ELSE p.text END), lambda t: t IS NOT NULL), lambda t: {_clean('t')}), lambda t: t <> '')"
_SAID = f"array_to_string(list_filter({_PARTS_CLEAN}, lambda t, i: list_position({_PARTS_CLEAN}, t) = i), chr(10) || chr(10))"
_RAW_SAID = _strip("array_to_string(list_filter(list_transform(coalesce(payload.content, []), lambda p: CASE WHEN p.type = 'input_image' THEN '[image sha256:' || sha256('{\"type\": \"input_image\"}') || ']' ELSE p.text END), lambda t: t IS NOT NULL), chr(10))")
_T, _PT, _IT = "coalesce(type, '')", "coalesce(payload.type, '')", "coalesce(payload.item.type, '')"
_HEAD = r"'^(?:(?:Chunk ID|Wall time|Original token count):[^\n]*\n|Process exited with code[^\n]*\n){0,7}Output:(?:\n|$)'"
_BODY = _strip(f"regexp_replace({_clean('payload.item.output')}, {_HEAD}, '')")
_CODE = r"nullif(regexp_extract(payload.item.output, '^(?:(?:Chunk ID|Wall time|Original token count):[^\n]*\n){0,7}Process exited with code\s+(-?\d+)', 1), '')"
_CMD1 = _strip("json_extract_string(payload.item.arguments, '$.cmd')")
_CHANGES = """list_transform(map_entries(payload.item.changes), lambda c: 'File: ' || c.key || chr(10) || chr(10) || 'Change type: ' || coalesce(c.value.type, 'unknown') || coalesce(chr(10) || chr(10) || 'content:' || chr(10) || c.value.content, ''))"""
_NEW = f"""SELECT 'rollout_lines' AS table_name, session_id, line_no, concat_ws('/', coalesce(nullif(type, ''), '-'), coalesce(nullif(payload.type, ''), '-'), coalesce(nullif(payload.item.type, ''), '-')) AS event, {_T} AS t, {_PT} AS p, {_IT} AS i,
CASE WHEN {_PT} = 'item_completed' AND {_IT} = 'FileChange' THEN 'action' WHEN {_IT} IN ('local_shell_call', 'local_shell_call_output') THEN 'action' WHEN {_PT} IN ('user_message', 'agent_message', 'assistant_message') THEN 'message' END AS kind,
CASE WHEN {_PT} = 'user_message' THEN 'user' WHEN {_PT} IN ('agent_message', 'assistant_message') THEN 'assistant' ELSE 'tool' END AS role,
CASE WHEN {_IT} <> '' THEN {_IT} ELSE {_PT} END AS source_type,
CASE WHEN {_IT} = 'FileChange' THEN concat_ws(chr(10) || chr(10), 'File change status: ' || coalesce(payload.item.status, 'unknown'), array_to_string({_CHANGES}, chr(10) || chr(10)))
 WHEN {_IT} = 'local_shell_call' THEN 'Ran ' || regexp_replace({_CMD1}, '\\s+', ' ', 'g') || chr(10) || chr(10) || {_fence("('$ ' || " + _CMD1 + ")", "'ps1'")}
 WHEN {_IT} = 'local_shell_call_output' AND {_BODY} <> '' THEN {_fence(_BODY, _guess(_BODY))} || CASE WHEN {_CODE} = '0' THEN chr(10) || chr(10) || 'Success' WHEN {_CODE} IS NOT NULL THEN chr(10) || chr(10) || 'Exit code ' || {_CODE} ELSE '' END
 WHEN {_PT} IN ('user_message', 'agent_message', 'assistant_message') THEN {_clean('payload.message')} END AS text,
CASE WHEN {_IT} = 'local_shell_call' THEN lower(regexp_replace({_CMD1}, '\\s+', ' ', 'g')) END AS command_key,
CASE WHEN {_IT} = 'local_shell_call_output' AND {_BODY} <> '' THEN sha256({_BODY}) END AS output_key,
CASE WHEN {_PT} = 'user_message' THEN {_strip('payload.message')} END AS prompt, 'event/user_message' AS surface, payload.turn_id AS turn_id, payload.replacement_history IS NOT NULL AS has_history FROM ev"""
_OLD = f"""SELECT 'response_items' AS table_name, session_id, item_id AS line_no, concat_ws('/', coalesce(nullif(type, ''), '-'), coalesce(nullif(payload.type, ''), '-'), '-') AS event, {_T} AS t, {_PT} AS p, '' AS i,
CASE WHEN {_PT} LIKE 'function_call%' THEN 'action' WHEN {_PT} IN ('user_message', 'agent_message') OR ({_PT} <> 'reasoning' AND (payload.role IN ('user', 'assistant', 'system') OR lower(payload.role) = 'user')) THEN 'message' END AS kind,
CASE WHEN {_PT} LIKE 'function_call%' THEN 'tool' WHEN {_PT} = 'user_message' OR lower(payload.role) = 'user' THEN 'user' WHEN {_PT} = 'agent_message' THEN 'assistant' ELSE payload.role END AS role,
{_PT} AS source_type,
CASE WHEN {_PT} LIKE 'function_call%' THEN nullif({_SAID}, '') WHEN {_PT} NOT IN ('user_message', 'agent_message') AND payload.role NOT IN ('user', 'assistant', 'system') THEN {_RAW_SAID} ELSE {_SAID} END AS text0,
NULL AS command_key, CASE WHEN {_PT} LIKE 'function_call%' THEN sha256(nullif({_SAID}, '')) END AS output_key,
CASE WHEN {_PT} = 'user_message' OR lower(payload.role) = 'user' THEN {_RAW_SAID} END AS prompt,
CASE WHEN {_PT} = 'user_message' THEN 'event/user_message' WHEN type = 'response_item' THEN 'response_item/message' ELSE 'generic/user' END AS surface, NULL AS turn_id, false AS has_history, lower(payload.role) AS said_role FROM response_items"""
_REASONED = """CASE WHEN t = 'token_usage_record' THEN 'telemetry_token_count' WHEN p = 'reasoning' THEN 'reasoning_summary_opt_in_disabled' WHEN t IN ('turn_context', 'session_meta') THEN 'metadata_only'
WHEN t = 'compacted' OR p = 'thread_rolled_back' THEN 'context_history_event' WHEN t = 'response_item' AND p IN ('message', 'function_call', 'function_call_output') THEN 'known_response_item_not_rendered_or_duplicate' ELSE 'unrecognized_schema' END"""
_ALL = f"""{_EV}, new AS ({_NEW}), old0 AS ({_OLD}), old AS (SELECT *, CASE WHEN kind = 'action' THEN {_fence('text0', _guess('text0'))} ELSE text0 END AS text FROM old0),
every AS (SELECT table_name, session_id, line_no, event, t, p, i, kind, role, source_type, text, command_key, output_key, prompt, surface, turn_id, has_history, '' AS said_role FROM new UNION ALL
SELECT table_name, session_id, line_no, event, t, p, i, kind, role, source_type, text, command_key, output_key, prompt, surface, turn_id, has_history, coalesce(said_role, '') FROM old),
done AS (SELECT *, kind IS NOT NULL AND coalesce(text, '') <> '' AS recognized FROM every)"""
_ACTS = "(t NOT IN ('session_meta', 'turn_context', 'token_usage_record', 'compacted', 'world_state') AND said_role NOT IN ('system', 'developer') AND (t IN ('response_item', 'event_msg') OR i <> '' OR said_role <> ''))"
_NL = f"""{_EV}, n0 AS (SELECT session_id, line_no, coalesce(payload.message, '') || chr(10) AS raw, type = 'session_meta' AS meta, type = 'turn_context' AS context FROM ev),
nl AS (SELECT *, CAST(sum(strlen(raw)) OVER w - strlen(raw) AS BIGINT) AS byte_start, CAST(sum(strlen(raw)) OVER w AS BIGINT) AS byte_end, row_number() OVER w AS pos FROM n0 WINDOW w AS (PARTITION BY session_id ORDER BY line_no))"""
# picked: lines in the excerpt with their kind; the rest is gaps and islands over the lines' positions
_PROV = """r AS (SELECT *, sum(CASE WHEN pos = prev_pos + 1 AND kind = prev_kind THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY pos) AS island
FROM (SELECT *, lag(pos) OVER v AS prev_pos, lag(kind) OVER v AS prev_kind FROM picked WINDOW v AS (PARTITION BY session_id ORDER BY pos))),
g AS (SELECT session_id, kind, min(line_no) AS line_start, max(line_no) AS line_end, min(byte_start) AS byte_start, max(byte_end) AS byte_end, sha256(string_agg(raw, '' ORDER BY line_no)) AS sha256 FROM r GROUP BY session_id, island, kind)
SELECT session_id, line_start, line_end, byte_start, byte_end, kind, CAST(sum(line_end - line_start + 1) OVER w - (line_end - line_start) AS BIGINT) AS excerpt_line_start, CAST(sum(line_end - line_start + 1) OVER w AS BIGINT) AS excerpt_line_end,
CAST(sum(byte_end - byte_start) OVER w - (byte_end - byte_start) AS BIGINT) AS excerpt_byte_start, CAST(sum(byte_end - byte_start) OVER w AS BIGINT) AS excerpt_byte_end, sha256 FROM g WINDOW w AS (PARTITION BY session_id ORDER BY byte_start)"""
# sel: selected lines of nl.  Context: the last turn context before each run of them that is not selected, and the first metadata line before all
_CONTEXT = """heads AS (SELECT session_id, line_no FROM (SELECT *, lag(pos) OVER (PARTITION BY session_id ORDER BY pos) AS prev FROM sel) WHERE prev IS NULL OR pos > prev + 1),
ctx AS (SELECT DISTINCT h.session_id, max(c.line_no) AS line_no FROM heads h JOIN nl c ON c.session_id = h.session_id AND c.context AND c.line_no < h.line_no GROUP BY h.session_id, h.line_no),
meta AS (SELECT session_id, min(line_no) AS line_no FROM nl WHERE meta GROUP BY session_id),
extra AS (SELECT session_id, line_no FROM ctx UNION SELECT m.session_id, m.line_no FROM meta m JOIN (SELECT session_id, min(line_no) AS f FROM sel GROUP BY session_id) s ON s.session_id = m.session_id AND m.line_no < s.f),
picked AS (SELECT nl.*, 'selected' AS kind FROM nl SEMI JOIN sel USING (session_id, line_no) UNION ALL SELECT nl.*, 'context' FROM nl SEMI JOIN extra USING (session_id, line_no) ANTI JOIN sel USING (session_id, line_no))"""
_TI = f"""{_ALL}, seq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM done WHERE table_name = 'rollout_lines'),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS turn_no, CAST(NULL AS BIGINT) AS line_no, '' AS turn_id, '' AS pending, false AS active, CAST(NULL AS VARCHAR) AS sha FROM (SELECT DISTINCT session_id FROM seq)
UNION ALL SELECT s.session_id, s.n, CASE WHEN said THEN f.turn_no + 1 ELSE f.turn_no END, CASE WHEN said THEN s.line_no ELSE f.line_no END,
CASE WHEN said THEN coalesce(nullif(s.turn_id, ''), f.pending) WHEN s.t = 'turn_context' AND f.turn_no > 0 AND NOT f.active AND coalesce(s.turn_id, '') <> '' AND f.turn_id IN ('', s.turn_id) THEN s.turn_id ELSE f.turn_id END,
CASE WHEN said THEN '' WHEN s.t = 'turn_context' THEN CASE WHEN f.turn_no > 0 AND NOT f.active AND coalesce(s.turn_id, '') <> '' AND f.turn_id IN ('', s.turn_id) THEN '' ELSE coalesce(s.turn_id, '') END WHEN acts THEN '' ELSE f.pending END,
CASE WHEN said THEN false WHEN acts THEN true ELSE f.active END, CASE WHEN said THEN sha256(s.prompt) ELSE f.sha END
FROM fold f JOIN (SELECT *, coalesce(prompt, '') <> '' AS said, {_ACTS} AS acts FROM seq) s ON s.session_id = f.session_id AND s.n = f.n + 1)"""
_FIRST = "(SELECT session_id, turn_no, min(line_no) AS line_no FROM (SELECT session_id, line_no, count(*) FILTER (coalesce(prompt, '') <> '') OVER (PARTITION BY session_id ORDER BY line_no) AS turn_no FROM done WHERE table_name = 'rollout_lines') GROUP BY ALL)"
_SEL_TURN = f"""WITH {_ALL}, {_NL[len(_EV) + 2:]}, tn AS (SELECT session_id, line_no, count(*) FILTER (coalesce(prompt, '') <> '') OVER (PARTITION BY session_id ORDER BY line_no) AS turn_no FROM done WHERE table_name = 'rollout_lines'),
sel AS (SELECT nl.* FROM nl JOIN tn USING (session_id, line_no) WHERE turn_no IN (2, 3)), {_CONTEXT}, {_PROV}"""
from loomlog.plans.log_queries import _REC  # noqa: E402

_LINES_OF = lambda where: f"{_REC}, {_NL[len(_EV) + 2:]}, sel AS (SELECT nl.* FROM nl SEMI JOIN (SELECT * FROM rec WHERE {where}) USING (session_id, line_no))"

# filters in order (recursive), pairing and blocks in closed form, as in the queries of their own
_POST = f"""{_ALL}, rr AS (SELECT session_id, line_no, kind, role, source_type, text, command_key, output_key, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM done WHERE table_name = 'rollout_lines' AND recognized),
kk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n) AS m FROM rr WHERE kind = 'action' AND (command_key IS NOT NULL OR output_key IS NOT NULL)),
ff AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS os, false AS kept FROM kk
UNION ALL SELECT kk.session_id, kk.m, kk.n, CASE WHEN command_key IS NOT NULL AND NOT list_contains(cs, command_key) THEN list_append(cs, command_key)[-12:] ELSE cs END, CASE WHEN output_key IS NOT NULL AND NOT list_contains(os, output_key) THEN list_append(os, output_key)[-3:] ELSE os END,
NOT coalesce(list_contains(cs, command_key), false) AND NOT coalesce(list_contains(os, output_key), false) FROM ff JOIN kk ON kk.session_id = ff.session_id AND kk.m = ff.m + 1),
fr AS (SELECT *, kind = 'action' AND command_key IS NOT NULL AND output_key IS NULL AS is_cmd, kind = 'action' AND output_key IS NOT NULL AND command_key IS NULL AS is_out FROM rr
WHERE NOT (kind = 'action' AND (command_key IS NOT NULL OR output_key IS NOT NULL)) OR EXISTS (SELECT 1 FROM ff WHERE ff.session_id = rr.session_id AND ff.n = rr.n AND ff.kept)),
sg AS (SELECT *, sum(CASE WHEN is_cmd OR is_out THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY n) AS seg FROM fr),
lv AS (SELECT *, sum(CASE WHEN is_cmd THEN 1 ELSE -1 END) OVER (PARTITION BY session_id, seg ORDER BY n) AS level FROM sg WHERE is_cmd OR is_out),
ad AS (SELECT *, is_cmd OR level >= least(coalesce(min(level) OVER (PARTITION BY session_id, seg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS admitted FROM lv),
nu AS (SELECT *, row_number() OVER (PARTITION BY session_id, seg, is_cmd ORDER BY n) AS k FROM ad WHERE admitted),
pr AS (SELECT c.session_id, c.n AS cn, o.n AS orn, c.line_no AS cl, o.line_no AS ol, c.seg, regexp_replace(c.text, '\\s+$', '') || chr(10) || chr(10) || regexp_replace(o.text, '\\s+$', '') AS text, c.text AS alone, c.source_type FROM nu c LEFT JOIN nu o ON o.session_id = c.session_id AND o.seg = c.seg AND o.k = c.k AND o.is_out WHERE c.is_cmd),
ends AS (SELECT session_id, seg, max(n) AS last_n FROM sg GROUP BY ALL),
al AS (SELECT session_id, n AS place, 1 AS sub, n AS tie, kind, role, source_type, [line_no] AS source_lines, text, CAST(is_out AS INTEGER) AS ran0 FROM sg WHERE NOT is_cmd AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.session_id = sg.session_id AND pr.orn = sg.n)
UNION ALL SELECT session_id, orn, 1, cn, 'action', 'tool', source_type, list_sort([cl, ol]), text, 0 FROM pr WHERE orn IS NOT NULL
UNION ALL SELECT p.session_id, e.last_n, 2, cn, 'action', 'tool', source_type, [cl], alone, 0 FROM pr p JOIN ends e ON e.session_id = p.session_id AND e.seg = p.seg WHERE orn IS NULL),
isl AS (SELECT *, sum(CASE WHEN kind = 'action' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY place, sub, tie) AS island FROM al),
blk AS (SELECT session_id, island, min_by(place, struct_pack(a := place, b := sub, c := tie)) AS place, min_by(sub, struct_pack(a := place, b := sub, c := tie)) AS sub, min_by(tie, struct_pack(a := place, b := sub, c := tie)) AS tie, list_sort(list_distinct(flatten(list(source_lines)))) AS source_lines,
count(*) FILTER (starts_with(text, 'Ran ')) AS ran, {", ".join(f"CAST(sum(len(regexp_extract_all(text, '(?m)^{v} file$'))) AS BIGINT) AS {v.lower()}" for v in ("Created", "Edited", "Deleted"))} FROM isl WHERE kind = 'action' GROUP BY session_id, island),
sm AS (SELECT *, concat_ws(', ', {", ".join(f"CASE WHEN {v.lower()} > 0 THEN '{v} ' || {v.lower()} || ' file' || CASE WHEN {v.lower()} = 1 THEN '' ELSE 's' END END" for v in ("Created", "Edited", "Deleted"))},
CASE WHEN ran > 0 THEN CASE WHEN created + edited + deleted > 0 THEN 'ran ' ELSE 'Ran ' END || ran || ' command' || CASE WHEN ran = 1 THEN '' ELSE 's' END END) AS text FROM blk),
un AS (SELECT session_id, place, sub, tie, 1 AS own, kind, role, source_type, source_lines, text FROM al UNION ALL SELECT session_id, place, sub, tie, 0, 'note', 'system', 'summary', source_lines, text FROM sm WHERE text <> '')"""

SQL = {
    "event_records": f"WITH {_ALL} SELECT table_name, session_id, line_no, kind, role, source_type, sha256(text) AS text_sha256, command_key, output_key FROM done WHERE recognized",
    "event_status": f"""WITH {_ALL} SELECT table_name, CASE WHEN recognized THEN 'recognized' ELSE 'ignored' END AS status, event, CASE WHEN NOT recognized THEN {_REASONED} END AS reason, count(*) AS n FROM done GROUP BY ALL""",
    "user_signals": f"WITH {_ALL} SELECT table_name, session_id, line_no, surface, sha256(prompt) AS prompt_sha256, nullif(turn_id, '') AS turn_id, false AS injected FROM done WHERE coalesce(prompt, '') <> ''",
    "history_events": f"WITH {_ALL} SELECT session_id, line_no, CASE WHEN has_history THEN 'replacement_history' WHEN p <> '' THEN p ELSE t END AS history, has_history OR t = 'compacted' AS replaces FROM done WHERE table_name = 'rollout_lines' AND (has_history OR t = 'compacted' OR p = 'thread_rolled_back')",
    "activity_counts": f"WITH {_ALL} SELECT table_name, session_id, count(*) AS n FROM done WHERE {_ACTS} AND coalesce(prompt, '') = '' GROUP BY ALL",
    "turn_index": f"WITH RECURSIVE {_TI} SELECT session_id, turn_no, any_value(line_no) AS line_no, nullif(max_by(turn_id, n), '') AS turn_id, any_value(sha) AS text_sha256, 0 AS duplicates FROM fold WHERE turn_no > 0 GROUP BY session_id, turn_no",
    "post_processed": f"WITH RECURSIVE {_POST} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place, sub, tie, own) AS position, kind, role, source_type, source_lines, sha256(text) AS text_sha256 FROM un",
    "turn_merge": f"WITH RECURSIVE {_TI} SELECT session_id, turn_no, any_value(line_no) AS line_no, nullif(max_by(turn_id, n), '') AS turn_id, 1 AS duplicates FROM fold WHERE turn_no > 0 GROUP BY session_id, turn_no",
    "source_times": "SELECT line_id, CASE WHEN line_id % 4 < 3 THEN nullif(trim(timestamp), '') END AS stated FROM rollout_lines",
    "parse_audit": """WITH r AS (SELECT record_id, raw_json, (length(raw_json) - length(replace(raw_json, '":"', ''))) // 3 AS n FROM drift_records),
x AS (SELECT record_id || ':whole' AS record_id, 'exact' AS status, 0 AS repairs, NULL AS raw FROM r UNION ALL SELECT record_id || ':cut', 'error', 0, left(raw_json, length(raw_json) - 1) FROM r
UNION ALL SELECT record_id || ':escape', CASE WHEN n > 0 THEN 'repaired_escapes' ELSE 'exact' END, n, CASE WHEN n > 0 THEN replace(raw_json, '":"', '":"\\q') END FROM r
UNION ALL SELECT record_id || ':list', 'not_object', 0, '[' || raw_json || ']' FROM r UNION ALL SELECT record_id || ':blank', 'blank', 0, NULL FROM r)
SELECT record_id, status, CAST(repairs AS INTEGER) AS repairs, sha256(raw) AS sha256 FROM x""",
    "turn_excerpt": _SEL_TURN,
    "record_excerpt": f"WITH {_LINES_OF('''kind = 'message' AND role = 'assistant' ''')}, {_CONTEXT}, {_PROV}",
    "range_merge": f"""WITH {_LINES_OF('''kind = 'message' ''')}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY session_id ORDER BY pos) AS island FROM sel)
SELECT session_id, min(line_no) AS line_start, max(line_no) AS line_end, min(byte_start) AS byte_start, max(byte_end) AS byte_end FROM r GROUP BY session_id, island""",
}
