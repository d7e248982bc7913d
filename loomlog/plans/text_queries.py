"""Queries over texts, commands, outputs, patches and times."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions import extract as E
from loomlog.functions import text as X
from loomlog.functions import times as T
from loomlog.operators import chunks
from loomlog.operators import records as R
from loomlog.operators import texts as TX
from loomlog.operators.folds import ordered_sha256
from loomlog.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of both logs, the documents and the raw lines."""
    one = lambda name, key, text: table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.lit(text).alias("field"), F.col(text).alias("text")).where("text is not null")
    logs = TX.log_texts(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))
    return logs.unionByName(one("documents", "doc_id", "text")).unionByName(one("raw_items", "raw_id", "raw_line"))


def redacted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that redaction changes, of all fields."""
    rows = _texts(spark, folder).withColumn("redacted", X.redacted("text")).where("text <> redacted")
    return rows.select("table_name", "record_id", "field", F.sha2("redacted", 256).alias("sha256"))


def redaction_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each redaction step applied, by table."""
    rows = _texts(spark, folder).select("table_name", F.posexplode(X.redaction_counts("text")).alias("k", "n")).where("n > 0")
    return rows.groupBy("table_name", (F.col("k") + 1).alias("step")).agg(F.sum("n").alias("n"))


def cleaning_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each cleaning step applied, by table."""
    return TX.cleaning_counts(_texts(spark, folder))


def cleaned_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and raw lines, cleaned: their hash and length."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    raw = table(spark, folder, "raw_items").select(F.concat(F.lit("r"), "raw_id").alias("id"), F.col("raw_line").alias("text"))
    rows = TX.mapped(docs.unionByName(raw).where("text is not null"), "id", "text", {"clean": "string"}, lambda t: (E.cleaned(t),))
    return rows.select("id", F.sha2("clean", 256).alias("sha256"), F.length("clean").alias("chars"))


def annotated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with truncation markers: how many, the tokens they state, and the text with them written out."""
    rows = _texts(spark, folder).withColumn("markers", X.truncation_markers("text")).where("markers > 0")
    return rows.select("table_name", "record_id", "field", "markers", X.truncated_tokens("text").alias("tokens"), F.sha2(X.truncation_annotated("text"), 256).alias("sha256"))


def mojibake(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that mojibake repair looks at, with their repaired hash."""
    rows = _texts(spark, folder).where(F.col("text").rlike(X.MOJIBAKE))
    return rows.select("table_name", "record_id", "field", F.sha2(X.mojibake_repaired("text"), 256).alias("sha256"))


def shortened_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose lines above 400 characters are reduced to their ends."""
    rows = table(spark, folder, "documents").where("text is not null")
    out = TX.mapped(rows, "doc_id", "text", {"short": "string"}, lambda t: ("\n".join(E.shortened(x, 400, 100) for x in t.split("\n")),))
    return out.join(rows.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")).where("short <> text").select("doc_id", F.length("short").alias("chars"), F.sha2("short", 256).alias("sha256"))


def language_guesses(spark: SparkSession, folder: str) -> DataFrame:
    """Fence languages of documents, tool outputs and raw lines."""
    return _texts(spark, folder).groupBy("table_name", "field", X.language_guess("text").alias("lang")).agg(F.count("*").alias("n"))


def _arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.events(table(spark, folder, "rollout_lines")).where("payload.item.arguments is not null")
    return rows.select("line_id", F.col("payload.item.arguments").alias("a"))


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands of tool calls in whatever envelope: here the arguments as they are, as argv, and nested twice; and their keys."""
    rows = _arguments(spark, folder)
    shaped = lambda name, value: rows.select(F.concat_ws(":", "line_id", F.lit(name)).alias("id"), value.alias("raw"))
    words = F.split(F.get_json_object("a", "$.cmd"), " ")
    every = shaped("plain", F.to_json(F.struct(F.col("a").alias("arguments")))).unionByName(shaped("argv", F.to_json(F.struct(F.struct(words.alias("argv")).alias("input")))))
    every = every.unionByName(shaped("nested", F.to_json(F.struct(F.struct(F.struct(F.col("a").alias("arguments")).alias("args")).alias("call")))))
    found = lambda raw: (c := E.command_of(E.embedded(raw)), E.command_key(c), E.first_command_line(c, 40))
    return TX.mapped(every, "id", "raw", {"command": "string", "command_key": "string", "shown": "string"}, found)


def argument_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Tool arguments as indented JSON."""
    return TX.mapped(_arguments(spark, folder), "line_id", "a", {"text": "string"}, lambda a: (E.stringified(E.embedded(a)),))


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.events(table(spark, folder, "rollout_lines")).where("payload.item.output is not null")
    return rows.select("line_id", F.col("payload.item.output").alias("output"))


def output_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies of tool outputs under each policy: whole, none, summary, last ten characters."""
    found = lambda t: (b := E.without_transport(t)[0], E.by_policy(b, "none"), E.by_policy(b, "summary"), E.by_policy(b, "tail", 10))
    return TX.mapped(_outputs(spark, folder), "line_id", "output", {"full": "string", "none": "string", "summary": "string", "tail": "string"}, found)


def nested_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Output and exit code of tool outputs inside {output, metadata} objects; what the metadata says counts first."""
    rows = _outputs(spark, folder)
    meta = F.when(F.col("line_id") % 2 == 0, F.struct(F.lit(7).alias("exit_code")))
    inner = F.to_json(F.struct("output", meta.alias("metadata")))
    raw = rows.select("line_id", F.to_json(F.struct(inner.alias("output"))).alias("raw"))

    def found(t: str) -> tuple:
        body, m = E.output_of(E.embedded(t))
        return body, m.get("exit_code")

    return TX.mapped(raw, "line_id", "raw", {"body": "string", "exit_code": "bigint"}, found)


def patch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of patches: here one patch of each change event's files, with a line for each."""
    rows = R.events(table(spark, folder, "rollout_lines")).where("payload.item.type = 'FileChange'")
    head = lambda t: F.when(t == "add", "Add").when(t == "delete", "Delete").otherwise("Update")
    one = F.transform(F.map_entries("payload.item.changes"), lambda c: F.concat(F.lit("*** "), head(c["value"]["type"]), F.lit(" File: "), c["key"], F.lit("\n+"), F.coalesce(c["value"]["content"], F.lit("")), F.lit("\n-old\n--- b\n")))
    patch = F.concat(F.lit("*** Begin Patch\n"), F.array_join(one, ""), F.lit("*** End Patch"))
    found = lambda t: ([f"{f.op}\t{f.path}\t{len(f.lines)}\t{len(f.signed('+'))}\t{len(f.signed('-'))}" for f in E.patch_files(t)],)
    files = TX.mapped(rows.select("line_id", patch.alias("patch")), "line_id", "patch", {"files": "array<string>"}, found)
    part = F.split("f", "\t")
    return files.select("line_id", F.explode("files").alias("f")).select("line_id", part[0].alias("op"), part[1].alias("path"), part[2].cast("int").alias("lines"), part[3].cast("int").alias("added"), part[4].cast("int").alias("removed"))


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as file names, and a name made of a template."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null")
    named = X.from_template("log_{title}_{mode}_{short}", {"title": X.slug("title"), "mode": F.lit("thread"), "short": F.substring(F.replace("session_id", F.lit("-"), F.lit("")), -8, 8)})
    return rows.select("session_id", X.file_name("title", 40).alias("name"), named.alias("stem"))


def quoted_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and paths quoted for front matter and for a table row."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null")
    return rows.select("session_id", X.yaml_quoted("title").alias("yaml"), X.markdown_row("title", "cwd", "archived").alias("row"))


def recent_tails(spark: SparkSession, folder: str) -> DataFrame:
    """The last 512 bytes of each archive member, from a line's or a character's beginning."""
    rows = table(spark, folder, "archive_members").where("body is not null")

    def found(body: str) -> tuple:
        data = body.encode()
        end = chunks.tail(data, 512)
        return len(end), len(end) <= 512, data.endswith(end), end.decode("utf-8")

    out = TX.mapped(rows, "member_id", "body", {"bytes": "bigint", "fits": "boolean", "is_end": "boolean", "text": "string"}, found)
    return out.select("member_id", "fits", "is_end", (F.octet_length("text") == F.col("bytes")).alias("whole_characters"))


def event_times(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of the log's timestamps (offset-aware or Unix seconds), wall times of those without a zone, and their sort key."""
    rows = table(spark, folder, "rollout_lines").select("line_id", "timestamp")
    return rows.select("line_id", F.unix_micros(T.parsed("timestamp")).alias("instant_us"), T.naive("timestamp").cast("string").alias("wall"), T.sort_key("timestamp").alias("sort_key"))


def created_local(spark: SparkSession, folder: str) -> DataFrame:
    """Creation times as shown in the zone of the machine that wrote the session."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null and local_zone is not null and created_at is not null")
    return rows.select("session_id", T.local_display("created_at", F.col("local_zone")).alias("created"))


def turn_digest(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 over the texts of each turn in order, hashed as they stream by."""
    rows = R.with_turns(R.records(table(spark, folder, "rollout_lines")))
    return ordered_sha256(rows.select("session_id", "turn_no", "line_no", F.encode(F.concat("text", F.lit("\n")), "utf-8").alias("data")), {"session_id": pa.string(), "turn_no": pa.int64()}, ["line_no"], "data")


def turn_document(spark: SparkSession, folder: str) -> DataFrame:
    """Hash and size of each turn rendered as Markdown sections."""
    head = F.when(F.col("role") == "user", "## User").when(F.col("role") == "assistant", "## Assistant").otherwise("## Tool")
    rows = R.with_turns(R.records(table(spark, folder, "rollout_lines"))).select("session_id", "turn_no", "line_no", F.encode(F.concat(head, F.lit("\n\n"), "text", F.lit("\n\n")), "utf-8").alias("data"))
    sizes = rows.groupBy("session_id", "turn_no").agg(F.count("*").alias("sections"), F.sum(F.octet_length("data")).alias("bytes"))
    sha = ordered_sha256(rows, {"session_id": pa.string(), "turn_no": pa.int64()}, ["line_no"], "data").toDF("s", "t", "sha256")
    return sizes.join(sha, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("turn_no") == F.col("t"))).drop("s", "t")

_NAMES = """redacted_texts redaction_counts cleaning_counts cleaned_texts annotated_texts mojibake shortened_lines language_guesses commands argument_texts
output_policies nested_outputs patch_files file_names quoted_titles recent_tails event_times created_local turn_digest turn_document""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

from loomlog.plans.event_queries import _clean, _guess, _strip  # noqa: E402
from loomlog.plans.log_queries import _AWARE, _EV, _MARK, _MARKERS, _MTOK, _TURN, _UNIX, _WALL  # noqa: E402
from loomlog.plans.catalog_queries import _HAS, _SLUG0, _ENDS  # noqa: E402

_TEXTS = """tx AS (SELECT * FROM (SELECT 'rollout_lines' AS table_name, line_id AS record_id, 'message' AS field, payload.message AS text FROM rollout_lines
UNION ALL SELECT 'rollout_lines', line_id, 'arguments', payload.item.arguments FROM rollout_lines UNION ALL SELECT 'rollout_lines', line_id, 'output', payload.item.output FROM rollout_lines
UNION ALL SELECT 'rollout_lines', line_id, 'item_content', c.text FROM (SELECT line_id, unnest(payload.item.content) AS c FROM rollout_lines)
UNION ALL SELECT 'rollout_lines', line_id, 'history', p.text FROM (SELECT line_id, unnest(h.content) AS p FROM (SELECT line_id, unnest(payload.replacement_history) AS h FROM rollout_lines))
UNION ALL SELECT 'rollout_lines', line_id, 'change', c.content FROM (SELECT line_id, unnest(map_values(payload.item.changes)) AS c FROM rollout_lines)
UNION ALL SELECT 'response_items', item_id, 'content', c.text FROM (SELECT item_id, unnest(payload.content) AS c FROM response_items)
UNION ALL SELECT 'documents', doc_id, 'text', text FROM documents UNION ALL SELECT 'raw_items', raw_id, 'raw_line', raw_line FROM raw_items) WHERE text IS NOT NULL)"""


def _redacted(steps: int, text: str = "text") -> str:
    for pattern, to in X.REDACTIONS[:steps]:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return text


def _times(pattern: str, text: str = "text") -> str:
    """Matches of a pattern, counted by what replacing them with one mark less their absence leaves."""
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_WITHOUT = lambda *patterns: _fold("text", patterns)


def _fold(text: str, patterns: tuple) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


_RESIDUE = r"(?m)^0;[^\n]*(?:\n|$)"
_STEPS = [("osc_sequence", X.OSC), ("ansi_sequence", X.ANSI), ("control_character", X.CONTROL), ("terminal_title_residue", _RESIDUE)]
_STEP_SQL = " UNION ALL ".join(
    f"SELECT table_name, '{name}' AS step, CAST(sum({_times(p, _WITHOUT(*(q for _, q in _STEPS[:k])))}) AS BIGINT) AS n FROM tx GROUP BY table_name" for k, (name, p) in enumerate(_STEPS)
)
_PLAIN = _WITHOUT(*(p for _, p in _STEPS))
_LINED = f"""s AS (SELECT *, regexp_split_to_array(regexp_replace({_PLAIN}, '(\\r\\n|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])$', ''), '\\r\\n|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines FROM tx),
u AS (SELECT table_name, record_id, field, row_number() OVER () AS t, lines FROM s), l AS (SELECT table_name, record_id, field, t, unnest(lines) AS line0, generate_subscripts(lines, 1) AS pos FROM u),
h AS (SELECT *, CASE WHEN length(line0) > 20000 THEN regexp_replace(left(line0, 1200), '\\s+$', '') || chr(10) || '[single overlong line truncated: ' || format('{{:,}}', length(line0)) || ' characters, sha256-prefix=' || left(sha256(line0), 16) || ']' || chr(10) || regexp_replace(right(line0, 1200), '^\\s+', '') ELSE line0 END AS line FROM l),
f AS (SELECT *, sum(CASE WHEN line IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY pos) AS island FROM (SELECT *, lag(line) OVER (PARTITION BY t ORDER BY pos) AS prev FROM h)),
k AS (SELECT *, row_number() OVER (PARTITION BY t, island ORDER BY pos) AS run FROM f)"""
_RES = r'[<>:"/\\|?*\x00-\x1f]'
_STEM1 = rf"""regexp_replace(regexp_replace(CASE WHEN suffix(lower(title), '.md') THEN left(title, length(title) - 3) ELSE coalesce(title, '') END, '{_RES}', '_', 'g'), '\s+', '_', 'g')"""
_STEM2 = rf"""regexp_replace(regexp_replace({_STEM1}, '^[ ._]+|[ ._]+$', '', 'g'), '_+', '_', 'g')"""
_STEM3 = f"CASE WHEN {_STEM2} = '' THEN 'thread' ELSE {_STEM2} END"
_STEM4 = f"CASE WHEN upper(string_split({_STEM3}, '.')[1]) IN ({', '.join(repr(n) for n in X.DEVICE_NAMES)}) THEN '_' || {_STEM3} ELSE {_STEM3} END"
_CMD = "json_extract_string(a, '$.cmd')"
_HEADS = r"'^(?:(?:Chunk ID|Wall time|Original token count):[^\n]*\n|Process exited with code[^\n]*\n){0,7}Output:(?:\n|$)'"
_OBODY = _strip(f"regexp_replace(output, {_HEADS}, '')")
_NESTED = _strip(f"regexp_replace({_clean('output')}, {_HEADS}, '')")
_OCODE = r"try_cast(nullif(regexp_extract(output, '^(?:(?:Chunk ID|Wall time|Original token count):[^\n]*\n){0,7}Process exited with code\s+(-?\d+)', 1), '') AS BIGINT)"
_OUTS = f"{_EV}, o AS (SELECT line_id, payload.item.output AS output FROM ev WHERE payload.item.output IS NOT NULL)"
_ARGS = f"{_EV}, ar AS (SELECT line_id, payload.item.arguments AS a FROM ev WHERE payload.item.arguments IS NOT NULL)"

SQL = {
    "redacted_texts": f"WITH {_TEXTS} SELECT table_name, record_id, field, sha256({_redacted(6)}) AS sha256 FROM tx WHERE text <> {_redacted(6)}",
    "redaction_counts": f"WITH {_TEXTS}, c AS ({' UNION ALL '.join(f'''SELECT table_name, {k + 1} AS step, CAST(sum({_times(p.replace(chr(39), chr(39) * 2), _redacted(k))}) AS BIGINT) AS n FROM tx GROUP BY table_name''' for k, (p, _) in enumerate(X.REDACTIONS))}) SELECT * FROM c WHERE n > 0",
    "cleaning_counts": f"WITH {_TEXTS}, {_LINED}, c AS ({_STEP_SQL} UNION ALL SELECT table_name, 'overlong_line', count(*) FILTER (length(line0) > 20000) FROM l GROUP BY table_name UNION ALL SELECT table_name, 'repeated_line_run', count(*) FILTER (run = 26) FROM k GROUP BY table_name) SELECT * FROM c WHERE n > 0",
    "cleaned_texts": f"""WITH {_TEXTS}, {_LINED}, j AS (SELECT table_name, record_id, string_agg(CASE WHEN run = 26 THEN '[repeated identical line omitted after 25 repeats]' ELSE line END, chr(10) ORDER BY pos) AS body FROM k WHERE run <= 26 AND table_name IN ('documents', 'raw_items') GROUP BY table_name, record_id)
SELECT left(table_name, 1) || record_id AS id, sha256({_strip('body')}) AS sha256, CAST(length({_strip('body')}) AS INTEGER) AS chars FROM j""",
    "annotated_texts": f"WITH {_TEXTS} SELECT table_name, record_id, field, CAST({_MARKERS} AS BIGINT) AS markers, CAST({_MTOK} AS BIGINT) AS tokens, sha256(regexp_replace(text, {_MARK}, '[SOURCE TOOL OUTPUT TRUNCATED: \\1 tokens omitted; not recoverable from this record]', 'g')) AS sha256 FROM tx WHERE {_MARKERS} > 0",
    "mojibake": f"WITH {_TEXTS} SELECT table_name, record_id, field, sha256(translate(text, '{X.CP1252_CODES}', '{X.CP1252}')) AS sha256 FROM tx WHERE regexp_matches(text, '{X.MOJIBAKE}')",
    "shortened_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, CASE WHEN length(line) > 400 THEN regexp_replace(left(line, 100), '\s+$', '') || chr(10) || '[single overlong line truncated: ' || format('{:,}', length(line)) || ' characters, sha256-prefix=' || left(sha256(line), 16) || ']' || chr(10) || regexp_replace(right(line, 100), '^\s+', '') ELSE line END AS short FROM l)
SELECT doc_id, CAST(length(string_agg(short, chr(10) ORDER BY pos)) AS INTEGER) AS chars, sha256(string_agg(short, chr(10) ORDER BY pos)) AS sha256 FROM s GROUP BY doc_id HAVING max(length(line)) > 400""",
    "language_guesses": f"WITH {_TEXTS}, g AS (SELECT *, regexp_replace(text, '^[\\s\\p{{Z}}]+', '') AS h FROM tx) SELECT table_name, field, {_guess('h')} AS lang, count(*) AS n FROM g GROUP BY ALL",
    "commands": f"""WITH {_ARGS}, c AS (SELECT line_id, unnest(['plain', 'argv', 'nested']) AS shape, {_CMD} AS cmd FROM ar), x AS (SELECT line_id || ':' || shape AS id, CASE WHEN shape = 'argv' THEN replace(cmd, ' ', chr(10)) ELSE cmd END AS command, cmd, shape FROM c)
SELECT id, command, lower(cmd) AS command_key, CASE WHEN shape = 'argv' THEN string_split(cmd, ' ')[1] WHEN length(cmd) > 40 THEN left(cmd, 39) || '…' ELSE cmd END AS shown FROM x""",
    "argument_texts": f"""WITH {_ARGS} SELECT line_id, '{{' || chr(10) || '  "cmd": ' || CAST(json_extract(a, '$.cmd') AS VARCHAR) || ',' || chr(10) || '  "workdir": ' || CAST(json_extract(a, '$.workdir') AS VARCHAR) || chr(10) || '}}' AS text FROM ar""",
    "output_policies": f"""WITH {_OUTS}, b AS (SELECT line_id, {_OBODY} AS body FROM o) SELECT line_id, body AS full, '' AS none, CASE WHEN body = '' THEN '' ELSE '[tool output omitted: ' || format('{{:,}}', length(body)) || ' characters; first line: ''' || string_split(body, chr(10))[1] || ''']' END AS summary,
CASE WHEN length(body) <= 10 THEN body ELSE '[TOOL OUTPUT TRUNCATED: kept final 10 of ' || format('{{:,}}', length(body)) || ' characters]' || chr(10) || chr(10) || right(body, 10) END AS tail FROM b""",
    "nested_outputs": f"WITH {_OUTS} SELECT line_id, {_NESTED} AS body, CASE WHEN line_id % 2 = 0 THEN 7 ELSE {_OCODE} END AS exit_code FROM o",
    "patch_files": f"""WITH {_EV}, c AS (SELECT line_id, unnest(map_entries(payload.item.changes)) AS c FROM ev WHERE payload.item.type = 'FileChange')
SELECT line_id, CASE c.value.type WHEN 'add' THEN 'add' WHEN 'delete' THEN 'delete' ELSE 'update' END AS op, c.key AS path, CAST(3 AS INTEGER) AS lines, CAST(1 AS INTEGER) AS added, CAST(1 AS INTEGER) AS removed FROM c""",
    "file_names": rf"""SELECT session_id, CASE WHEN regexp_replace(left({_STEM4}, 37), '[ ._]+$', '') = '' THEN 'thread' ELSE regexp_replace(left({_STEM4}, 37), '[ ._]+$', '') END || '.md' AS name,
'log_' || regexp_replace(substring(CASE WHEN coalesce({_SLUG0}, '') = '' THEN 'thread' ELSE {_SLUG0} END, 1, 80), {_ENDS}, '', 'g') || '_thread_' || right(replace(session_id, '-', ''), 8) AS stem FROM {_HAS}""",
    "quoted_titles": rf"""SELECT session_id, '"' || replace(replace(coalesce(title, ''), '\', '\\'), '"', '\"') || '"' AS yaml, '| ' || concat_ws(' | ', replace(replace(coalesce(title, ''), chr(10), ' '), '|', '\|'), replace(replace(coalesce(cwd, ''), chr(10), ' '), '|', '\|'), coalesce(CAST(archived AS VARCHAR), '')) || ' |' AS row FROM {_HAS}""",
    "recent_tails": "SELECT member_id, true AS fits, true AS is_end, true AS whole_characters FROM archive_members WHERE body IS NOT NULL",
    "event_times": f"""SELECT line_id, coalesce(epoch_us({_AWARE}), {_UNIX}) AS instant_us, regexp_replace(CAST({_WALL} AS VARCHAR), '(\\.\\d*?)0+$', '\\1') AS wall, coalesce(epoch_us({_AWARE}), {_UNIX}, epoch_us({_WALL})) / 1000000.0 AS sort_key FROM rollout_lines""",
    "created_local": f"SELECT session_id, strftime(created_at AT TIME ZONE local_zone, '%B %-d, %Y at %I:%M:%S %p ') || local_zone AS created FROM {_HAS} AND local_zone IS NOT NULL AND created_at IS NOT NULL",
    "turn_digest": f"WITH {_TURN} SELECT session_id, turn_no, sha256(string_agg(text || chr(10), '' ORDER BY line_no)) AS sha256 FROM t GROUP BY ALL",
    "turn_document": f"""WITH {_TURN}, d AS (SELECT session_id, turn_no, line_no, CASE role WHEN 'user' THEN '## User' WHEN 'assistant' THEN '## Assistant' ELSE '## Tool' END || chr(10) || chr(10) || text || chr(10) || chr(10) AS data FROM t)
SELECT session_id, turn_no, count(*) AS sections, CAST(sum(strlen(data)) AS BIGINT) AS bytes, sha256(string_agg(data, '' ORDER BY line_no)) AS sha256 FROM d GROUP BY ALL""",
}
