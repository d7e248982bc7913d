"""Session audits, counters, selections by occurrence and prefix, documents, bundles, and what the sinks report."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomlog.functions import context as CX
from loomlog.functions import text as X
from loomlog.operators import catalog as C
from loomlog.operators import records as R
from loomlog.operators import sequences as Q
from loomlog.operators import texts as TX
from loomlog.operators.running import running
from loomlog.plans.log_queries import is_prompt, is_reply
from loomlog.sinks import archives, documents, files
from loomlog.sources import exported
from loomlog.sources.tables import table
from loomlog.storage import materialize, scratch_path


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return R.classified(table(spark, folder, "rollout_lines"))


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = _classified(spark, folder)
    kept = F.col("status") == "recognized"
    stamped = kept & (F.coalesce("timestamp", F.lit("")) != "")
    said = F.when(kept, F.col("text"))
    total = lambda c: F.coalesce(F.sum(F.when(kept, c)), F.lit(0)).cast("bigint")
    return rows.withColumn("said", said).groupBy("session_id").agg(
        F.min_by("timestamp", F.when(stamped, F.col("line_no"))).alias("created_at"), F.max_by("timestamp", F.when(stamped, F.col("line_no"))).alias("updated_at"),
        F.count("*").alias("events"), F.count_if(kept).alias("records"), F.count_if(kept & is_prompt()).alias("prompts"), F.count_if(kept & is_prompt()).alias("responses"),
        F.count_if(kept & is_reply()).alias("replies"), F.count_if(kept & (F.col("kind") == "action")).alias("actions"), F.count_if(kept & (F.col("kind") == "note")).alias("notes"),
        total(X.cards("text", "Created file")).alias("created_cards"), total(X.cards("text", "Edited file")).alias("edited_cards"), total(X.cards("text", "Deleted file")).alias("deleted_cards"),
        F.count_if(F.col("event").startswith("compacted/")).alias("compactions"), F.count_if(F.col("event").contains("/thread_rolled_back/")).alias("rollbacks"),
        F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(F.col("status") != "recognized").alias("ignored"),
        F.coalesce(F.sum(X.truncation_markers("said")), F.lit(0)).alias("markers"), F.coalesce(F.sum(X.truncated_tokens("said")), F.lit(0)).alias("marked_tokens"),
        total(X.lines("text")).alias("lines"), total(X.tokens("text")).alias("tokens"),
    )


def session_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each session holds: first and last time in line order, events, records by kind, file cards, history changes, unknown
    and ignored events, truncation markers, sizes."""
    return _audit(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of each session as JSON."""
    counts = ["events", "records", "prompts", "responses", "replies", "actions", "notes", "compactions", "rollbacks", "unknown", "ignored", "markers"]
    cards = F.struct(*(F.col(f"{c}_cards").alias(c) for c in ("created", "edited", "deleted")))
    return _audit(spark, folder).select("session_id", F.to_json(F.struct(F.struct(*counts).alias("counts"), cards.alias("files"), F.struct("lines", "tokens").alias("size"))).alias("manifest"))


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of one pass over the log: lines, rendered, ignored by reason, events by key, adjacent repeats, markers."""
    rows = _classified(spark, folder)
    kept = F.col("status") == "recognized"
    hashed = running(rows.where(kept).select("session_id", "line_no", F.xxhash64("kind", "role", "text").alias("h")), ["session_id"], "line_no", {"last": ("max", F.struct("line_no", "h"))}, before_only=True)
    each = F.array(
        F.struct(F.lit("lines").alias("counter"), F.lit(1).cast("bigint").alias("n")), F.struct(F.concat(F.lit("event_"), "event").alias("counter"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.when(kept, "rendered").otherwise(F.concat(F.lit("ignored_"), "reason")).alias("counter"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("markers").alias("counter"), F.when(kept, X.truncation_markers("text")).otherwise(0).alias("n")),
    )
    counted = rows.select(F.inline(each)).unionByName(hashed.select(F.lit("adjacent_repeats").alias("counter"), F.coalesce(F.col("last.h") == F.col("h"), F.lit(False)).cast("bigint").alias("n")))
    return counted.groupBy("counter").agg(F.sum("n").alias("n")).where("n > 0")


def mode_chat_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and actions, without notes."""
    rows = R.records(table(spark, folder, "rollout_lines"))
    return rows.where("kind in ('message', 'action')").select("session_id", "line_no", "kind", "role")


def response_n(spark: SparkSession, folder: str) -> DataFrame:
    """What answers the third prompt of each session."""
    rows = R.with_turns(R.records(table(spark, folder, "rollout_lines")))
    return rows.where("turn_no = 3 and role <> 'user'").select("session_id", "line_no", "kind", "role")


def second_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """The second prompt of each session that names a module; sessions with fewer have none."""
    rows = R.records(table(spark, folder, "rollout_lines")).where(is_prompt() & X.search_key("text").contains("once"))
    return Q.numbered(rows, ["session_id"], "line_no", "k").where("k = 2").select("session_id", "line_no")


def prefix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each first three characters of a session id: how many sessions they could mean, and the session if it is one."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null").groupBy(F.substring("session_id", 1, 3).alias("wanted"))
    return rows.agg(F.count("*").alias("n"), F.min("session_id").alias("s")).select("wanted", "n", F.when(F.col("n") == 1, F.col("s")).alias("session_id"))


def catalog_status(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by status that hold every word of a query in title, path, project and source."""
    rows = C.reconciled(C.seen_sessions(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items")), table(spark, folder, "session_catalog")).where(C.all_words("THE s", "title", "cwd", "project_id", "source"))
    return rows.select(F.explode(F.array(*(F.when(C.has_status(s), F.lit(s)) for s in C.STATUSES))).alias("status")).where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def listing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 2 to 4 and 7 of the sessions by creation, newest first."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null and created_at is not null")
    wanted = CX.row_numbers("2-4,7", 7)
    top = rows.orderBy(*C.sort_columns("created_at:desc", "session_id")).limit(max(wanted)).select("session_id", "created_at")
    order = W.orderBy(*C.sort_columns("created_at:desc", "session_id"))  # over the few rows on top
    return top.withColumn("row", F.row_number().over(order)).where(F.col("row").isin(wanted)).select("row", "session_id")


def typed_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source in the order of their sizes, given as text with thousands separators; nulls last, ties by id."""
    rows = table(spark, folder, "documents").where("source is not null").select("source", "doc_id", F.format_number("n_chars", 0).alias("shown")).withColumn("size", X.number_key("shown"))
    # a rank by counting what comes before, so that no source is sorted in one task
    before = running(rows, ["source"], "size", {"before": ("sum", F.lit(1).cast("bigint"))}, before_only=True, block=256)
    tie = F.row_number().over(W.partitionBy("source", "size").orderBy("doc_id"))
    return before.select("source", "doc_id", "shown", (F.coalesce("before", F.lit(0)) + tie).alias("rank"))


def capped_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first 30 redelivered lines and the first 100 lines with truncation markers, in the order of the log."""
    rows = table(spark, folder, "rollout_lines").select("line_id", "session_id", "line_no", F.col("payload.message").alias("text"))
    again = rows.groupBy("session_id", "line_no").agg(F.max("line_id").alias("line_id"), F.count("*").alias("n")).where("n > 1").select("line_id")
    marked = rows.where(X.truncation_markers("text") > 0).select("line_id")
    first = lambda df, n, name: df.orderBy("line_id").limit(n).select(F.lit(name).alias("sample"), "line_id")
    return first(again, 30, "repeated").unionByName(first(marked, 100, "truncated"))


def basket(spark: SparkSession, folder: str) -> DataFrame:
    """A keyed set of sessions: those of a source are put in, archived ones taken out, and those updated last put in again."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null")
    put = rows.where("source = 'cli'").select("session_id")
    out = rows.where("archived = 1").select("session_id")
    again = rows.where("updated_at is not null").groupBy("source").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id")).select("session_id")
    return put.join(out, "session_id", "left_anti").unionByName(again).distinct()


def session_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Models and working folders of each session in the order in which they were first seen; models are put into the events."""
    rows = R.events(table(spark, folder, "rollout_lines"))
    raw = F.to_json(F.struct(F.struct(F.when(F.col("type") == "turn_context", F.concat(F.lit(" m"), F.pmod(F.col("line_no") * 7, F.lit(5)))).alias("model"), F.struct("source").alias("settings")).alias("payload")))
    fields = {"models": ["$.model", "$.payload.model"], "sources": ["$.payload.settings.source"]}
    return C.session_metadata(rows.select("session_id", "line_no", raw.alias("raw")), fields)


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each session as a Markdown file with front matter, written as it streams by and read back."""
    records = materialize(R.records(table(spark, folder, "rollout_lines")).where("session_id is not null"), "records")
    summary = records.groupBy("session_id").agg(F.count_if(is_prompt()).alias("prompts"), F.count_if(is_reply()).alias("replies"), F.count_if(F.col("kind") == "action").alias("actions"))
    root = scratch_path(spark, "documents")
    written = materialize(documents.write(documents.sections(records, summary), root), "written")
    if written.isEmpty():
        return spark.createDataFrame([], "session_id string, sections bigint, bytes bigint, sha256 string, same boolean")
    back = spark.read.format("binaryFile").load(f"{root}/*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("s"), F.sha2("content", 256).alias("read"))
    return written.join(back, F.col("session_id") == F.col("s")).select("session_id", "sections", "bytes", "sha256", (F.col("read") == F.col("sha256")).alias("same"))


def counted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under a head that states their own lines and tokens, rendered until the numbers are right."""
    word = re.compile(r"\w+|[^\w\s]")
    size = lambda t: (t.count("\n") + (0 if t.endswith(("\n", "\r")) else 1), len(word.findall(t)))

    def counted(text: str) -> tuple[int, int, bool]:
        whole = documents.with_own_counts(lambda lines, tokens: f"Lines: {lines}\nTokens: {tokens}\n\n{text}", size)
        lines, tokens = size(whole)
        return lines, tokens, whole.startswith(f"Lines: {lines}\nTokens: {tokens}\n")

    return TX.mapped(table(spark, folder, "documents").where("text is not null"), "doc_id", "text", {"lines": "bigint", "tokens": "bigint", "stated": "boolean"}, counted)


def existing_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Documents out of earlier exports: plain files, and archives of one document with a manifest that fits it; others are refused."""
    rows = table(spark, folder, "archive_members").select("member_id", F.coalesce("body", F.lit("")).alias("body"))
    root = scratch_path(spark, "exports")
    materialize(files.publish(exported.as_exports(rows), root), "published")
    if rows.isEmpty():
        return spark.createDataFrame([], "member_id bigint, refused string, sha256 string")
    found = exported.read(spark, f"{root}/*")
    return found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("member_id"), "refused", F.sha2("text", 256).alias("sha256"))


def latest_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log file of the highest member, written after all others: the one with the latest change."""
    from loomlog.sources import lines

    rows = table(spark, folder, "archive_members").select(F.format_string("sessions/rollout-%s-%d.jsonl", "session_id", "member_id").alias("path"), "member_id", F.encode(F.coalesce("body", F.lit("")), "utf-8").alias("data"))
    last = rows.agg(F.max("member_id")).first()[0]
    if last is None:
        return spark.createDataFrame([], "member_id bigint, session_id string")
    root = scratch_path(spark, "latest")
    for part in (rows.where(F.col("member_id") != last), rows.where(F.col("member_id") == last)):
        materialize(files.publish(part, root), "published")
        time.sleep(0.05)  # files differ by a tick of the file system's clock
    found = lines.latest_file(lines.discover(spark, root))
    return found.select(F.regexp_extract("path", r"-(\d+)\.jsonl$", 1).cast("bigint").alias("member_id"), "session_id")


def bundle_index(spark: SparkSession, folder: str) -> DataFrame:
    """Records written by source, and the index of the bundle: rows and sessions of each part, read back from it."""
    root = scratch_path(spark, "bundle")
    rows = R.records(table(spark, folder, "rollout_lines")).select("source", "session_id", "line_no", "kind", "role", "text")
    rows.write.partitionBy("source").parquet(root)
    return spark.read.parquet(root).groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions"), F.sum(F.octet_length("text")).alias("bytes"))


def publish_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Titles written twice under each collision policy, the second time changed for every other session."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null").select("session_id", F.coalesce("title", F.lit("")).alias("title"))
    changed = F.substring("session_id", 1, 1).isin(*"02468ace")
    data = lambda extra: F.encode(F.concat("title", extra), "utf-8").alias("data")
    root, out = scratch_path(spark, "publish"), []
    for policy in ("rename", "overwrite", "skip"):
        path = F.concat(F.lit(f"{policy}/"), "session_id", F.lit(".txt")).alias("path")
        materialize(files.publish(rows.select(path, data(F.lit(""))), root, policy), "published")
        second = files.publish(rows.select(path, data(F.when(changed, "!").otherwise(""))), root, policy)
        out.append(materialize(second.select(F.lit(policy).alias("policy"), F.regexp_extract("path", r"/([^/]+)\.txt$", 1).alias("session_id"), "outcome", (F.col("path") != F.col("written_path")).alias("renamed")), "published"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def archive_plan(spark: SparkSession, folder: str) -> DataFrame:
    """How each archive member would be packed under a cap of 8 KiB: whole, tried whole, or in parts; with its estimated compression."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for body in b.column("body").to_pylist():
                raw = (body or "").encode()
                share = archives.probe(raw)
                out.append((len(raw), share, archives.strategy(len(raw), share, 8192), len(archives.ranged(raw, 8192))))
            kinds = [pa.int64(), pa.float64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("member_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["member_id", "bytes", "share", "strategy", "pieces"])

    return table(spark, folder, "archive_members").select("member_id", "body").mapInArrow(run, "member_id bigint, bytes bigint, share double, strategy string, pieces bigint")


_NAMES = """session_audit manifest stream_counters mode_chat_actions response_n second_occurrence prefix_lookup catalog_status listing_rows typed_sort capped_samples
basket session_metadata stream_documents bundle_index publish_outcomes archive_plan counted_documents existing_exports latest_log""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

from loomlog.plans.catalog_queries import _BOTH, _HAS, _SEEN  # noqa: E402
from loomlog.plans.log_queries import _BOT, _EV, _IGN, _LINES, _MARK, _MARKERS, _MTOK, _REASON, _REC, _SEARCH, _TOK, _TURN, _USER, _cards  # noqa: E402

_AUDIT = f"""{_IGN}, a AS (SELECT session_id, line_no, timestamp, kind, role, text, source_type AS event, 'recognized' AS status FROM rec UNION ALL SELECT session_id, line_no, timestamp, NULL, NULL, NULL, event, CASE WHEN {_REASON} = 'unrecognized_schema' THEN 'unknown' ELSE 'ignored' END FROM ign),
au AS (SELECT session_id, arg_min(timestamp, line_no) FILTER (status = 'recognized' AND coalesce(timestamp, '') <> '') AS created_at, arg_max(timestamp, line_no) FILTER (status = 'recognized' AND coalesce(timestamp, '') <> '') AS updated_at,
count(*) AS events, count(*) FILTER (status = 'recognized') AS records, count(*) FILTER ({_USER}) AS prompts, count(*) FILTER ({_USER}) AS responses, count(*) FILTER ({_BOT}) AS replies, count(*) FILTER (kind = 'action') AS actions, count(*) FILTER (kind = 'note') AS notes,
CAST(coalesce(sum({_cards('Created')}), 0) AS BIGINT) AS created_cards, CAST(coalesce(sum({_cards('Edited')}), 0) AS BIGINT) AS edited_cards, CAST(coalesce(sum({_cards('Deleted')}), 0) AS BIGINT) AS deleted_cards,
count(*) FILTER (starts_with(event, 'compacted/')) AS compactions, count(*) FILTER (contains(event, '/thread_rolled_back/')) AS rollbacks, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status <> 'recognized') AS ignored,
CAST(coalesce(sum({_MARKERS}), 0) AS BIGINT) AS markers, CAST(coalesce(sum(CASE WHEN text IS NOT NULL THEN {_MTOK} END), 0) AS BIGINT) AS marked_tokens, CAST(coalesce(sum(CASE WHEN text IS NOT NULL THEN {_LINES} END), 0) AS BIGINT) AS lines, CAST(coalesce(sum({_TOK}), 0) AS BIGINT) AS tokens FROM a GROUP BY session_id)"""
_DOC = f"""{_REC}, d AS (SELECT session_id, line_no, CASE role WHEN 'user' THEN '## User' WHEN 'assistant' THEN '## Assistant' WHEN 'tool' THEN '## Tool' ELSE '## Note' END || chr(10) || chr(10) || CASE WHEN coalesce(timestamp, '') <> '' THEN '*' || timestamp || '*' || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) AS data FROM rec
UNION ALL SELECT session_id, -1, '---' || chr(10) || 'session: "' || session_id || '"' || chr(10) || 'prompts: ' || count(*) FILTER ({_USER}) || chr(10) || 'replies: ' || count(*) FILTER ({_BOT}) || chr(10) || 'actions: ' || count(*) FILTER (kind = 'action') || chr(10) || '---' || chr(10) || chr(10) FROM rec GROUP BY session_id)"""

SQL = {
    "session_audit": f"WITH {_AUDIT} SELECT * FROM au",
    "manifest": f"""WITH {_AUDIT} SELECT session_id, '{{"counts":{{' || concat_ws(',', {", ".join(f"'{chr(34)}{c}{chr(34)}:' || {c}" for c in ("events", "records", "prompts", "responses", "replies", "actions", "notes", "compactions", "rollbacks", "unknown", "ignored", "markers"))})
|| '}},"files":{{"created":' || created_cards || ',"edited":' || edited_cards || ',"deleted":' || deleted_cards || '}},"size":{{"lines":' || lines || ',"tokens":' || tokens || '}}}}' AS manifest FROM au""",
    "stream_counters": f"""WITH {_IGN}, c AS (SELECT 'lines' AS counter, count(*) AS n FROM ev UNION ALL SELECT 'rendered', count(*) FROM rec UNION ALL SELECT 'event_' || source_type, count(*) FROM rec GROUP BY source_type UNION ALL SELECT 'event_' || event, count(*) FROM ign GROUP BY event
UNION ALL SELECT 'ignored_' || {_REASON}, count(*) FROM ign GROUP BY ALL UNION ALL SELECT 'markers', CAST(sum({_MARKERS}) AS BIGINT) FROM rec
UNION ALL SELECT 'adjacent_repeats', count(*) FROM (SELECT kind, role, text, lag(kind) OVER w AS k, lag(role) OVER w AS r, lag(text) OVER w AS t FROM rec WINDOW w AS (PARTITION BY session_id ORDER BY line_no)) WHERE kind = k AND role = r AND text = t)
SELECT counter, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY counter HAVING sum(n) > 0""",
    "mode_chat_actions": f"WITH {_REC} SELECT session_id, line_no, kind, role FROM rec WHERE kind IN ('message', 'action')",
    "response_n": f"WITH {_TURN} SELECT session_id, line_no, kind, role FROM t WHERE turn_no = 3 AND role <> 'user'",
    "second_occurrence": f"WITH {_REC} SELECT session_id, line_no FROM rec WHERE {_USER} AND contains({_SEARCH}, 'once') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_no) = 2",
    "prefix_lookup": f"SELECT left(session_id, 3) AS wanted, count(*) AS n, CASE WHEN count(*) = 1 THEN min(session_id) END AS session_id FROM {_HAS} GROUP BY ALL",
    "catalog_status": f"""WITH {_BOTH.replace("coalesce(rows, 0) AS rows", "coalesce(rows, 0) AS rows, lower(concat_ws(' ', coalesce(nullif(trim(c.title), ''), s.session_id, c.session_id), cwd, project_id, source)) AS hay")}, st AS (SELECT unnest(list_filter(['all', CASE WHEN available THEN 'available' END, CASE WHEN available AND archived <> 1 THEN 'live' END, CASE WHEN archived = 1 THEN 'archived' END, CASE WHEN NOT available THEN 'missing' END], lambda x: x IS NOT NULL)) AS status FROM r WHERE contains(hay, 'the') AND contains(hay, 's'))
SELECT status, count(*) AS n FROM st GROUP BY status""",
    "listing_rows": f"SELECT row, session_id FROM (SELECT session_id, CAST(row_number() OVER (ORDER BY created_at DESC, session_id) AS INTEGER) AS row FROM {_HAS} AND created_at IS NOT NULL) WHERE row IN (2, 3, 4, 7)",
    "typed_sort": "SELECT source, doc_id, format('{:,}', n_chars) AS shown, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents WHERE source IS NOT NULL",
    "capped_samples": f"""WITH a AS (SELECT max(line_id) AS line_id FROM rollout_lines GROUP BY session_id, line_no HAVING count(*) > 1 ORDER BY 1 LIMIT 30), m AS (SELECT line_id FROM (SELECT line_id, payload.message AS text FROM rollout_lines) WHERE {_MARKERS} > 0 ORDER BY 1 LIMIT 100)
SELECT 'repeated' AS sample, line_id FROM a UNION ALL SELECT 'truncated', line_id FROM m""",
    "basket": f"SELECT session_id FROM {_HAS} AND source = 'cli' AND archived IS DISTINCT FROM 1 UNION (SELECT max_by(session_id, struct_pack(a := updated_at, b := session_id)) FROM {_HAS} AND updated_at IS NOT NULL GROUP BY source)",
    "session_metadata": f"""WITH {_EV}, v AS (SELECT session_id, line_no, 'models' AS field, 'm' || (line_no * 7 % 5) AS value FROM ev WHERE type = 'turn_context' UNION ALL SELECT session_id, line_no, 'sources', source FROM ev WHERE source IS NOT NULL),
f AS (SELECT session_id, field, value, min(line_no) AS n FROM v GROUP BY ALL) SELECT session_id, field, list(value ORDER BY n) AS values FROM f GROUP BY session_id, field""",
    "stream_documents": f"WITH {_DOC} SELECT session_id, count(*) AS sections, CAST(sum(strlen(data)) AS BIGINT) AS bytes, sha256(string_agg(data, '' ORDER BY line_no)) AS sha256, true AS same FROM d WHERE session_id IS NOT NULL GROUP BY session_id",
    "counted_documents": f"SELECT doc_id, CAST({_LINES} AS BIGINT) + 3 AS lines, CAST({_TOK} AS BIGINT) + 6 AS tokens, true AS stated FROM documents WHERE text IS NOT NULL AND text <> ''",
    "existing_exports": """SELECT member_id, CASE member_id % 6 WHEN 2 THEN 'manifest does not fit' WHEN 3 THEN 'not one document' WHEN 4 THEN 'unreadable' WHEN 5 THEN 'unsafe_name' END AS refused, CASE WHEN member_id % 6 < 2 THEN sha256(coalesce(body, '')) END AS sha256 FROM archive_members""",
    "latest_log": "SELECT member_id, session_id FROM archive_members ORDER BY member_id DESC LIMIT 1",
    "bundle_index": f"WITH {_REC} SELECT source, count(*) AS rows, count(DISTINCT session_id) AS sessions, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM rec GROUP BY source",
    "publish_outcomes": f"""WITH c AS (SELECT session_id, session_id[1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS changed, unnest(['rename', 'overwrite', 'skip']) AS policy FROM {_HAS})
SELECT policy, session_id, CASE WHEN NOT changed THEN 'same' WHEN policy = 'rename' THEN 'written' WHEN policy = 'overwrite' THEN 'replaced' ELSE 'skipped' END AS outcome, changed AND policy = 'rename' AS renamed FROM c""",
}
