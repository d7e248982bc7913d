"""Queries over the session catalog, the message rows, the texts and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomlog.functions import context as CX
from loomlog.functions import text as X
from loomlog.functions import times as T
from loomlog.operators import catalog as C
from loomlog.operators import chunks
from loomlog.operators import records as R
from loomlog.operators import texts as TX
from loomlog.operators import tree
from loomlog.operators.running import ranked, running
from loomlog.sources.tables import table


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    return C.seen_sessions(table(spark, folder, "rollout_lines"), table(spark, folder, "response_items"))


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "session_catalog")


def source_union(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of both logs, each once."""
    return _seen(spark, folder).select("session_id", "log", "rows")


def catalog_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog and logs, reconciled."""
    return C.reconciled(_seen(spark, folder), _catalog(spark, folder)).select("session_id", "available", "in_catalog", "title", "archived", "rows")


def missing_rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog sessions that no log has."""
    return _catalog(spark, folder).where("session_id is not null").join(_seen(spark, folder), "session_id", "left_anti").select("session_id", "rollout_path")


def unindexed_rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the logs that the catalog lacks."""
    return _seen(spark, folder).join(_catalog(spark, folder), "session_id", "left_anti").select("session_id", "log")


def catalog_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the reconciliation."""
    r = C.reconciled(_seen(spark, folder), _catalog(spark, folder))
    return r.agg(
        F.count("*").alias("sessions"),
        F.count_if("available").alias("available"),
        F.count_if(~F.col("available")).alias("missing"),
        F.count_if(~F.col("in_catalog")).alias("unindexed"),
        F.count_if(F.col("archived") == 1).alias("archived"),
    )


def project_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by workspace: archived and missing ones, rows of their logs, last update."""
    rows = C.reconciled(_seen(spark, folder), _catalog(spark, folder)).withColumn("project", X.project_key("cwd", "project_id"))
    return rows.where("in_catalog").groupBy("project").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("archived") == 1).alias("archived"), F.count_if(~F.col("available")).alias("missing"), F.sum("rows").alias("rows"), F.max(T.epoch_seconds("updated_at")).alias("updated_s")
    )


def title_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Title of each session: the catalog's, else its first prompt in either log, else its id."""
    prompts = R.records(table(spark, folder, "rollout_lines")).where("kind = 'message' and role = 'user'").select("session_id", F.lit(0).alias("log"), F.col("line_no").alias("at"), "text")
    legacy = table(spark, folder, "response_items").where("payload.type in ('message', 'user_message') and (payload.type = 'user_message' or lower(trim(payload.role)) in ('user', 'human'))")
    said = F.array_join(F.filter(F.transform("payload.content", lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    legacy = legacy.select("session_id", F.lit(1).alias("log"), F.col("item_id").alias("at"), said.alias("text")).where(F.col("text").rlike(r"\S"))
    first = prompts.unionByName(legacy).groupBy("session_id").agg(F.min_by(X.preview("text", 80), F.struct("log", "at")).alias("prompt"))
    titles = _catalog(spark, folder).where("session_id is not null").select("session_id", F.nullif(X.collapsed(F.regexp_replace("title", r"^\s*#+\s*", "")), F.lit("")).alias("title"))
    both = titles.join(first, "session_id", "full_outer")
    return both.select("session_id", F.substring(F.coalesce("title", "prompt", "session_id"), 1, 200).alias("title"))


def best_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """Of redelivered lines the one that arrived last, ties by line_id."""
    lines = table(spark, folder, "rollout_lines")
    return lines.groupBy("session_id", "line_no").agg(F.count("*").alias("deliveries"), F.max_by("line_id", F.struct("received_at", "line_id")).alias("line_id")).where("deliveries > 1")


def sorted_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's sessions by title descending, nulls last, ties by id; with their rank."""
    rows = _catalog(spark, folder).where("session_id is not null").select(X.project_key("cwd", "project_id").alias("project"), "session_id", "title")
    return ranked(rows, ["project"], C.sort_columns("title:desc", "session_id"))


def listing_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of 50 of the sessions by creation, newest first."""
    rows = _catalog(spark, folder).where("session_id is not null and created_at is not null")
    return rows.orderBy(*C.sort_columns("created_at:desc", "session_id")).offset(50).limit(50).select("session_id", "title")


def search_and(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of which title, path, project and source hold every word of a query."""
    return _catalog(spark, folder).where(C.all_words("REDACTION step", "title", "cwd", "project_id", "source")).select("session_id", "title")


def path_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Workspace paths, normalised."""
    return _catalog(spark, folder).where("session_id is not null").select("session_id", X.path_key("cwd").alias("path"))


def project_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a project by name (the last part of the workspace, or the project id) and by whole path."""
    rows = _catalog(spark, folder)
    named = rows.where(C.in_project("lantern")).select(F.lit("name").alias("by"), "session_id", "cwd")
    return named.unionByName(rows.where(C.in_project("C:/Work/Lantern/")).select(F.lit("path").alias("by"), "session_id", "cwd"))


def latest_session(spark: SparkSession, folder: str) -> DataFrame:
    """The session of each source that was updated last."""
    rows = _catalog(spark, folder).where("session_id is not null and updated_at is not null")
    return rows.groupBy("source").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def session_head(spark: SparkSession, folder: str) -> DataFrame:
    """First turn id and type among the first eight lines of each session."""
    head = R.events(table(spark, folder, "rollout_lines").where("line_no <= 8"))
    given = F.when(F.col("payload.turn_id").isNotNull(), F.col("line_no"))
    return head.groupBy("session_id").agg(F.count("*").alias("lines"), F.min_by("type", "line_no").alias("first_type"), F.min_by("payload.turn_id", given).alias("first_turn_id"))


def path_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session ids and archive flags taken from file names."""
    rows = _catalog(spark, folder).where("rollout_path is not null")
    name = F.regexp_extract("rollout_path", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl(?:\.zst)?$", 1)
    return rows.select("rollout_path", F.nullif(name, F.lit("")).alias("named_session"), F.col("rollout_path").startswith("archived_sessions").alias("in_archive"), F.col("rollout_path").endswith(".zst").alias("compressed"))


def created_display(spark: SparkSession, folder: str) -> DataFrame:
    """Creation time as shown to readers, in UTC."""
    return _catalog(spark, folder).where("session_id is not null").select("session_id", T.display("created_at").alias("created"))


def updated_since(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions updated on or after a local midnight."""
    return _catalog(spark, folder).where(F.col("updated_at") >= T.since("2026-01-01", "UTC")).select("session_id", T.epoch_seconds("updated_at").alias("updated_s"))


def role_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows of each session by role."""
    rows = table(spark, folder, "response_items").where("payload.type = 'message'")
    return rows.groupBy("session_id", F.coalesce(F.lower(F.trim("payload.role")), F.lit("-")).alias("role")).agg(F.count("*").alias("n"))


def account_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, sessions, message rows and rows of repeated content of each source, and how many name a project."""
    rows = table(spark, folder, "response_items").select("source", "session_id", (F.col("payload.type") == "message").alias("message"), F.xxhash64(F.to_json(F.struct("session_id", "type", "timestamp", "payload"))).alias("content"))
    once = rows.groupBy("source", "session_id", "content").agg(F.count("*").alias("n"), F.count_if("message").alias("messages"))
    named = _catalog(spark, folder).where("session_id is not null and project_id is not null").select(F.col("session_id").alias("p")).distinct()
    once = once.join(named, F.col("session_id") == F.col("p"), "left")
    return once.groupBy("source").agg(
        F.sum("n").alias("scanned"), F.count_distinct("session_id").alias("sessions"), F.sum("messages").alias("messages"), F.sum(F.col("n") - 1).alias("repeated"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("with_project")
    )


def duplicate_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three line ids of each redelivered line, in order."""
    lines = table(spark, folder, "rollout_lines").select("session_id", "line_no", "line_id")
    key = W.partitionBy("session_id", "line_no")
    rows = lines.withColumn("n", F.count("*").over(key)).where("n > 1").withColumn("k", F.row_number().over(key.orderBy("line_id")))
    return rows.where("k <= 3").select("session_id", "line_no", "k", "line_id")


def line_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Missing line numbers between a session's lines, as ranges; every seventh line is left out first, and its next one in even sessions."""
    lines = table(spark, folder, "rollout_lines").select("session_id", "line_no").distinct()
    twice = F.substring("session_id", 1, 1).isin(*"02468ace")
    lines = lines.where((F.col("line_no") % 7 != 3) & ~(twice & (F.col("line_no") % 7 == 4)))
    before = running(lines, ["session_id"], "line_no", {"prev": ("max", F.col("line_no"))}, before_only=True)
    return before.where("line_no > prev + 1").select("session_id", (F.col("prev") + 1).alias("gap_start"), (F.col("line_no") - 1).alias("gap_end"))


def text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, lines, fence and preview of each document."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", X.tokens("text").alias("tokens"), X.lines("text").alias("lines"), F.length(X.fence("text")).alias("fence"), X.preview("text", 120).alias("preview"))


def title_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as file name parts."""
    return _catalog(spark, folder).where("session_id is not null").select("session_id", X.slug("title").alias("slug"))


def search_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of each document's search key."""
    return table(spark, folder, "documents").select("doc_id", F.sha2(X.search_key("text"), 256).alias("key"))


def member_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of archive members as shown to readers, with content digests."""
    rows = table(spark, folder, "archive_members")
    return rows.select("member_id", X.human_size("body_bytes").alias("size"), F.sha2("body", 256).alias("sha256"))


def repeat_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, each line of which comes up to five times, with runs of equal lines compacted beyond two."""
    again = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.array_repeat(x, i % 5 + 1)))
    return TX.compacted_runs(table(spark, folder, "documents").select("doc_id", F.array_join(again, "\n").alias("text")), 2)


def long_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines above 400 characters with their place."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.length("line") > 400).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("chars"))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parse status of each drifted record: exact, repaired or error."""
    return TX.parse_status(table(spark, folder, "drift_records").select("record_id", "raw_json")).select("record_id", "status", "repairs")


def embedded_json(spark: SparkSession, folder: str) -> DataFrame:
    """Strings that hold JSON objects or lists, on one line or several: what they hold, their command and working folder."""
    rows = R.events(table(spark, folder, "rollout_lines")).select("session_id", "line_no", F.trim("payload.item.arguments").alias("a"))
    shaped = F.array(F.col("a"), F.concat(F.lit("[\n"), "a", F.lit("\n]")), F.concat(F.lit(" "), F.replace("a", F.lit(","), F.lit(",\n"))), F.concat("a", F.lit("x")))
    rows = rows.where("a is not null").select("session_id", "line_no", F.posexplode(shaped).alias("shape", "a")).withColumn("a", F.trim("a"))
    rows = rows.where(F.col("a").rlike(r"(?s)^(?:\{.*\}|\[.*\])$") & F.expr("try_parse_json(a) is not null"))
    at = lambda k: F.coalesce(F.get_json_object("a", f"$.{k}"), F.get_json_object("a", f"$[0].{k}"))
    return rows.select("session_id", "line_no", "shape", F.when(F.col("a").startswith("["), "list").otherwise("object").alias("holds"), at("cmd").alias("command"), at("workdir").alias("workdir"))


def tree_preorder(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy rows of each session as a tree in depth-first order: a row hangs below the last message before it.

    Messages of a session form a chain as deep as the session is long."""
    rows = table(spark, folder, "response_items").where("session_id is not null")
    message = F.when(F.col("payload.type") == "message", F.col("item_id"))
    rows = running(rows.select("session_id", "item_id", message.alias("m")), ["session_id"], "item_id", {"up": ("max", F.col("m"))}, before_only=True)
    text = lambda c: F.col(c).cast("string")
    return tree.preorder(rows.select(F.col("session_id").alias("tree"), text("item_id").alias("id"), text("up").alias("parent"), F.col("item_id").alias("ordinal"), (-F.col("item_id")).alias("child_no")))


def segment_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into parts of 4096 bytes and put together again."""
    pieces = chunks.parts(table(spark, folder, "documents"), 4096)
    return chunks.reassembled(pieces).select("doc_id", "bytes", "sha256", "whole")


def chunk_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Byte ranges of the parts of every document."""
    return chunks.parts(table(spark, folder, "documents"), 4096).drop("body")


def context_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Whether messages are injected or service context as a whole: user messages as they are and in several envelopes."""
    rows = R.events(table(spark, folder, "rollout_lines")).where("payload.type = 'user_message' and payload.message is not null")
    text = F.col("payload.message")
    around = lambda tag, t, opening=None: F.concat(F.lit(f"<{opening or tag}>\n"), t, F.lit(f"</{tag.upper()}> "))
    heading = F.concat(F.lit("# AGENTS.md instructions for /w\n\n<INSTRUCTIONS>"), text, F.lit("</INSTRUCTIONS>\n"))
    aborted = around("turn_aborted", text)
    shapes = [text, around("environment_context", text), F.concat(around("user_instructions", text), heading), F.concat(around("environment_context", text), F.lit("please")), aborted, F.concat(aborted, around("in-app-browser-context", text, "in-app-browser-context source='ambient-ui-state'")), around("in-app-browser-context", text)]
    rows = rows.select("session_id", "line_no", F.posexplode(F.array(*shapes)).alias("shape", "text"))
    return rows.select("session_id", "line_no", "shape", CX.is_injected_context("text").alias("injected"), CX.is_service_context("text").alias("service"))


def chunk_promises(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of every document: whether each is within the limit, whole characters, and follows the one before."""
    pieces = chunks.parts(table(spark, folder, "documents"), 4096)
    order = W.partitionBy("doc_id").orderBy("byte_start")
    rows = pieces.withColumn("follows", F.col("byte_start") == F.coalesce(F.lag("byte_end").over(order), F.lit(0))).withColumn("lines", F.octet_length("body") - F.octet_length(F.replace(F.decode("body", "utf-8"), F.lit("\n"), F.lit(""))))
    whole = F.octet_length(F.encode(F.decode("body", "utf-8"), "utf-8")) == F.octet_length("body")
    return rows.groupBy("doc_id").agg(F.max("byte_end").alias("bytes"), F.every("follows").alias("follows"), F.every((F.octet_length("body") <= 4096) & whole).alias("fits"), F.sum("lines").cast("bigint").alias("line_ends"))


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour, counted by a stream over the closed table."""
    from loomlog.streaming import counts

    return counts.hourly(spark, f"{folder}/events.parquet")


_NAMES = """source_union catalog_full_outer missing_rollouts unindexed_rollouts catalog_audit project_rollup title_precedence best_delivery
sorted_listing listing_page search_and path_keys project_filter latest_session session_head path_sessions created_display updated_since
role_histogram account_inventory duplicate_samples line_gaps text_metrics    title_slugs search_keys
member_sizes repeat_runs long_lines json_lines embedded_json tree_preorder event_counts segment_reassembly chunk_parts chunk_promises context_flags""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

from loomlog.plans.log_queries import _EV, _MARK, _REC, _TOK, _LINES, _SEARCH, _preview  # noqa: E402

_SEEN = """u AS (SELECT session_id, 'rollout' AS log, count(*) AS rows, min(received_at) AS first_seen, max(received_at) AS last_seen FROM rollout_lines WHERE session_id IS NOT NULL GROUP BY session_id
UNION ALL SELECT session_id, 'legacy', count(*), min(received_at), max(received_at) FROM response_items WHERE session_id IS NOT NULL GROUP BY session_id),
seen AS (SELECT session_id, max_by(log, struct_pack(a := last_seen, b := log)) AS log, CAST(sum(rows) AS BIGINT) AS rows, max(last_seen) AS last_seen FROM u GROUP BY session_id)"""
_BOTH = f"""{_SEEN}, r AS (SELECT coalesce(s.session_id, c.session_id) AS session_id, s.session_id IS NOT NULL AS available, c.session_id IS NOT NULL AS in_catalog,
coalesce(nullif(trim(c.title), ''), s.session_id, c.session_id) AS title, coalesce(archived, 0) AS archived, coalesce(rows, 0) AS rows
FROM seen s FULL OUTER JOIN (SELECT * FROM session_catalog WHERE session_id IS NOT NULL) c ON s.session_id = c.session_id)"""
_PATH0 = r"replace(trim(coalesce(cwd, '')), '/', '\')"
_PATH = rf"lower(regexp_replace(CASE WHEN starts_with({_PATH0}, '\\?\UNC\') THEN '\\' || substr({_PATH0}, 9) WHEN starts_with({_PATH0}, '\\?\') THEN substr({_PATH0}, 5) ELSE {_PATH0} END, '\\+$', ''))"
_PJ0 = r"regexp_replace(replace(coalesce(cwd, ''), '\', '/'), '(.)/+$', '\1')"
_PROJECT = rf"CASE WHEN {_PJ0} <> '' THEN 'path:' || CASE WHEN regexp_matches({_PJ0}, '^(?:[A-Za-z]:(?:/|$)|//)') THEN lower({_PJ0}) ELSE {_PJ0} END WHEN coalesce(project_id, '') <> '' THEN 'id:' || project_id ELSE 'name:(unknown project)' END"
_HAS = "session_catalog WHERE session_id IS NOT NULL"
_FENCE = "greatest(coalesce(list_max(list_transform(regexp_extract_all(text, '(`+)', 1), lambda x: length(x))), 0) + 1, 3)"


def _redact_sql() -> str:
    out = "text"
    for pattern, to in X.REDACTIONS:
        to = to.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return out


_ENDS = r"'^[._\- ]+|[._\- ]+$'"
_SLUG0 = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{{L}}\p{{N}}_\s.-]+', '', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), {_ENDS}, '', 'g')"

SQL = {
    "source_union": f"WITH {_SEEN} SELECT session_id, log, rows FROM seen",
    "catalog_full_outer": f"WITH {_BOTH} SELECT * FROM r",
    "missing_rollouts": f"WITH {_SEEN} SELECT session_id, rollout_path FROM {_HAS} AND session_id NOT IN (SELECT session_id FROM seen)",
    "unindexed_rollouts": f"WITH {_SEEN} SELECT session_id, log FROM seen WHERE session_id NOT IN (SELECT session_id FROM {_HAS})",
    "catalog_audit": f"WITH {_BOTH} SELECT count(*) AS sessions, count(*) FILTER (available) AS available, count(*) FILTER (NOT available) AS missing, count(*) FILTER (NOT in_catalog) AS unindexed, count(*) FILTER (archived = 1) AS archived FROM r",
    "project_rollup": f"""WITH {_SEEN}, x AS (SELECT {_PROJECT} AS project, c.archived, s.session_id IS NULL AS missing, coalesce(s.rows, 0) AS rows, coalesce(c.updated_at, s.last_seen) AS updated_at FROM session_catalog c LEFT JOIN seen s ON s.session_id = c.session_id WHERE c.session_id IS NOT NULL)
SELECT project, count(*) AS sessions, count(*) FILTER (archived = 1) AS archived, count(*) FILTER (missing) AS missing, CAST(sum(rows) AS BIGINT) AS rows, CAST(max(epoch(updated_at)) AS DOUBLE) AS updated_s FROM x GROUP BY project""",
    "title_precedence": f"""WITH {_REC}, p AS (SELECT session_id, 0 AS log, line_no AS place, text FROM rec WHERE kind = 'message' AND role = 'user' UNION ALL
SELECT session_id, 1, item_id, array_to_string(list_filter(list_transform(payload.content, lambda c: c.text), lambda t: t IS NOT NULL), chr(10)) FROM response_items WHERE payload.type = 'user_message' OR (payload.type = 'message' AND lower(trim(payload.role)) IN ('user', 'human'))),
f AS (SELECT session_id, arg_min({_preview(80)}, struct_pack(a := log, b := place)) AS prompt FROM p WHERE regexp_matches(text, '\\S') GROUP BY session_id),
c AS (SELECT session_id, nullif(trim(regexp_replace(regexp_replace(title, '^\\s*#+\\s*', ''), '\\s+', ' ', 'g')), '') AS title FROM {_HAS})
SELECT coalesce(c.session_id, f.session_id) AS session_id, substring(coalesce(title, prompt, c.session_id, f.session_id), 1, 200) AS title FROM c FULL OUTER JOIN f ON c.session_id = f.session_id""",
    "best_delivery": "SELECT session_id, line_no, count(*) AS deliveries, max_by(line_id, struct_pack(a := received_at, b := line_id)) AS line_id FROM rollout_lines GROUP BY ALL HAVING count(*) > 1",
    "sorted_listing": f"SELECT project, session_id, title, row_number() OVER (PARTITION BY project ORDER BY title DESC NULLS LAST, session_id) AS rank FROM (SELECT {_PROJECT} AS project, session_id, title FROM {_HAS})",
    "listing_page": f"SELECT session_id, title FROM {_HAS} AND created_at IS NOT NULL ORDER BY created_at DESC, session_id LIMIT 50 OFFSET 50",
    "search_and": "SELECT session_id, title FROM session_catalog WHERE contains(lower(concat_ws(' ', title, cwd, project_id, source)), 'redaction') AND contains(lower(concat_ws(' ', title, cwd, project_id, source)), 'step')",
    "path_keys": f"SELECT session_id, {_PATH} AS path FROM {_HAS}",
    "project_filter": rf"SELECT 'name' AS by, session_id, cwd FROM session_catalog WHERE string_split({_PATH}, '\')[-1] = 'lantern' OR lower(project_id) = 'lantern' UNION ALL SELECT 'path', session_id, cwd FROM session_catalog WHERE {_PATH} = 'c:\work\lantern'",
    "latest_session": f"SELECT source, max_by(session_id, struct_pack(a := updated_at, b := session_id)) AS session_id FROM {_HAS} AND updated_at IS NOT NULL GROUP BY source",
    "session_head": f"WITH {_EV} SELECT session_id, count(*) AS lines, arg_min(type, line_no) AS first_type, arg_min(payload.turn_id, line_no) FILTER (payload.turn_id IS NOT NULL) AS first_turn_id FROM ev WHERE line_no <= 8 GROUP BY session_id",
    "path_sessions": r"SELECT rollout_path, nullif(regexp_extract(rollout_path, '([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl(?:\.zst)?$', 1), '') AS named_session, starts_with(rollout_path, 'archived_sessions') AS in_archive, suffix(rollout_path, '.zst') AS compressed FROM session_catalog WHERE rollout_path IS NOT NULL",
    "created_display": f"SELECT session_id, strftime(created_at AT TIME ZONE 'UTC', '%B %-d, %Y at %I:%M:%S %p UTC') AS created FROM {_HAS}",
    "updated_since": "SELECT session_id, CAST(epoch(updated_at) AS DOUBLE) AS updated_s FROM session_catalog WHERE updated_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00'",
    "role_histogram": "SELECT session_id, coalesce(lower(trim(payload.role)), '-') AS role, count(*) AS n FROM response_items WHERE payload.type = 'message' GROUP BY ALL",
    "account_inventory": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, session_id, type, timestamp, payload) AS k FROM response_items) SELECT source, count(*) AS scanned, count(DISTINCT session_id) AS sessions,
count(*) FILTER (payload.type = 'message') AS messages, count(*) FILTER (k > 1) AS repeated, count(*) FILTER (session_id IN (SELECT session_id FROM session_catalog WHERE session_id IS NOT NULL AND project_id IS NOT NULL)) AS with_project FROM r GROUP BY source""",
    "duplicate_samples": "SELECT session_id, line_no, k, line_id FROM (SELECT session_id, line_no, line_id, count(*) OVER (PARTITION BY session_id, line_no) AS n, row_number() OVER (PARTITION BY session_id, line_no ORDER BY line_id) AS k FROM rollout_lines) WHERE n > 1 AND k <= 3",
    "line_gaps": """SELECT session_id, prev + 1 AS gap_start, line_no - 1 AS gap_end FROM (SELECT session_id, line_no, lag(line_no) OVER (PARTITION BY session_id ORDER BY line_no) AS prev FROM (SELECT DISTINCT session_id, line_no FROM rollout_lines)
WHERE line_no % 7 <> 3 AND NOT (session_id[1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AND line_no % 7 = 4)) WHERE line_no > prev + 1""",
    "text_metrics": f"SELECT doc_id, CAST({_TOK} AS BIGINT) AS tokens, CAST({_LINES} AS BIGINT) AS lines, CAST({_FENCE} AS INTEGER) AS fence, {_preview(120)} AS preview FROM documents",
    "title_slugs": rf"SELECT session_id, regexp_replace(substring(CASE WHEN coalesce({_SLUG0}, '') = '' THEN 'thread' ELSE {_SLUG0} END, 1, 80), {_ENDS}, '', 'g') AS slug FROM {_HAS}",
    "search_keys": f"SELECT doc_id, sha256({_SEARCH}) AS key FROM documents",
    "member_sizes": """SELECT member_id, CASE WHEN body_bytes < 1024 THEN body_bytes || 'B' WHEN body_bytes < 1048576 THEN printf('%.1f', body_bytes / 1024) || 'KB' ELSE printf('%.1f', body_bytes / 1048576) || 'MB' END AS size, sha256(body) AS sha256 FROM archive_members""",
    "repeat_runs": """WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), l AS (SELECT doc_id, line, p * 10 + unnest(range(1, (p - 1) % 5 + 2)) AS pos FROM l0),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM line AS fresh FROM l), i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS k FROM i) SELECT doc_id, count(*) FILTER (k > 2) AS dropped, sha256(string_agg(line, chr(10) ORDER BY pos) FILTER (k <= 2)) AS sha256 FROM n GROUP BY doc_id HAVING count(*) FILTER (k > 2) > 0""",
    "long_lines": "SELECT doc_id, CAST(pos AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(line) > 400",
    "context_flags": f"WITH {_EV}, x AS (SELECT session_id, line_no, unnest([0, 1, 2, 3, 4, 5, 6]) AS shape FROM ev WHERE payload.type = 'user_message' AND payload.message IS NOT NULL) SELECT session_id, line_no, CAST(shape AS INTEGER) AS shape, shape IN (1, 2) AS injected, shape IN (4, 5) AS service FROM x",
    "chunk_promises": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, true AS follows, true AS fits, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_ends FROM documents WHERE text <> ''",
    "json_lines": "SELECT record_id, CASE WHEN coalesce(trim(raw_json), '') = '' THEN 'blank' WHEN NOT json_valid(raw_json) THEN 'error' WHEN json_type(raw_json) = 'OBJECT' THEN 'exact' ELSE 'not_object' END AS status, CAST(0 AS INTEGER) AS repairs FROM drift_records",
    "embedded_json": f"""WITH {_EV}, x AS (SELECT session_id, line_no, trim(payload.item.arguments) AS a FROM ev WHERE payload.item.arguments IS NOT NULL AND json_valid(payload.item.arguments)), y AS (SELECT *, unnest([0, 1, 2]) AS shape FROM x)
SELECT session_id, line_no, CAST(shape AS INTEGER) AS shape, CASE WHEN shape = 1 THEN 'list' ELSE 'object' END AS holds, json_extract_string(a, '$.cmd') AS command, json_extract_string(a, '$.workdir') AS workdir FROM y""",
    "tree_preorder": """WITH RECURSIVE n AS (SELECT session_id, item_id, max(CASE WHEN payload.type = 'message' THEN item_id END) OVER (PARTITION BY session_id ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM response_items WHERE session_id IS NOT NULL),
t AS (SELECT session_id, item_id, up, CAST(0 AS BIGINT) AS depth, CASE WHEN up IS NULL THEN [item_id] END AS path FROM n WHERE up IS NULL UNION ALL SELECT n.session_id, n.item_id, n.up, t.depth + 1, list_append(t.path, -n.item_id) FROM t JOIN n ON n.session_id = t.session_id AND n.up = t.item_id)
SELECT session_id AS tree, CAST(item_id AS VARCHAR) AS id, CAST(up AS VARCHAR) AS parent, depth, row_number() OVER (PARTITION BY session_id ORDER BY path) AS position FROM t""",
    "segment_reassembly": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, true AS whole FROM documents WHERE text <> ''",
    "event_counts": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL",
}
