"""The event log model: raw lines to events (one for each line) to classified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlog.functions import context as CX
from loomlog.functions import text as X
from loomlog.operators.running import running
from loomlog.storage import materialize

# Parts of type names that mark events as noise.
NOISE = ["token_count", "turn_context", "session_meta", "reasoning", "delta", "rate_limits"]
# Type names of lifecycle and specialised tool events.
LIFECYCLE = ["task_started", "task_complete", "turn_aborted", "thread_goal_updated", "thread_settings_applied"]
SPECIAL = ["web_search_call", "web_search_end", "tool_search_call", "tool_search_output", "mcp_tool_call_end", "view_image_tool_call"]
KNOWN_ITEMS = ["message", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output"]


def events(lines: DataFrame) -> DataFrame:
    """One row for each (session, line): the delivery with the smallest line_id."""
    first = W.partitionBy("session_id", "line_no").orderBy("line_id")
    return lines.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _or_dash(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))


def event_key(top: str = "type", payload: str = "payload.type", item: str = "payload.item.type") -> Column:
    """top/payload/item, - for what is missing."""
    return F.concat_ws("/", _or_dash(top), _or_dash(payload), _or_dash(item))


def ignored_reason(payload: str = "payload.type", item: str = "payload.item.type") -> Column:
    """Why an event that gives no record is passed over."""
    top, p = F.coalesce(F.col("type"), F.lit("")), F.coalesce(F.col(payload), F.lit(""))
    kind = F.lower(F.when(p.isin("item_completed", "item_started", "item_updated"), F.coalesce(F.col(item), F.lit(""))).otherwise(p))
    return (
        F.when((top == "response_item") & (kind == "additional_tools"), "tool_catalog_metadata")
        .when((top == "token_usage_record") | (kind == "token_count"), "telemetry_token_count")
        .when(kind == "agent_reasoning", "raw_reasoning_not_exported")
        .when(kind == "reasoning", "reasoning_summary_opt_in_disabled")
        .when((top == "event_msg") & (p == "item_completed") & (kind == "contextcompaction"), "context_history_event")
        .when(top.isin("turn_context", "session_meta", "world_state"), "metadata_only")
        .when((top == "compacted") | kind.isin("context_compacted", "thread_rolled_back"), "context_history_event")
        .when(kind.isin(LIFECYCLE), "lifecycle_event")
        .when(kind.isin(SPECIAL), "unsupported_tool_lifecycle_or_specialized_event")
        .when((top == "response_item") & kind.isin(KNOWN_ITEMS), "known_response_item_not_rendered_or_duplicate")
        .when((top == "event_msg") & (kind == "error"), "runtime_error_event")
        .otherwise("unrecognized_schema")
    )


def classified(lines: DataFrame) -> DataFrame:
    """Every event of typed lines with its key, what it passes over for, and (r, null if it gives none) its record.

    A user message on another surface than an explicit user event that is injected context as a whole, and any that is
    service context, is a note of the system."""
    e = events(lines)
    p, item = F.coalesce(F.col("payload.type"), F.lit("")), F.coalesce(F.col("payload.item.type"), F.lit(""))
    done = p == "item_completed"
    blob = F.lower(F.concat_ws(" ", F.coalesce("type", F.lit("")), p, item))
    noise = F.lit(False)
    for hint in NOISE:
        noise |= blob.contains(hint)
    parts = F.array_join(F.filter(F.transform("payload.item.content", lambda c: c["text"]), lambda t: t.isNotNull()), "\n")
    label = F.transform_values("payload.item.changes", lambda k, v: F.when(v["type"] == "add", "Created file").when(v["type"] == "delete", "Deleted file").otherwise("Edited file"))
    cards = F.array_join(F.transform(F.map_entries(label), lambda c: F.concat(c["value"], F.lit("\n"), c["key"])), "\n\n")
    changed = F.concat_ws("\n\n", F.concat(F.lit("Status: "), F.col("payload.item.status")), F.nullif(cards, F.lit("")))
    command = F.get_json_object("payload.item.arguments", "$.cmd")
    output = X.without_transport_header(F.col("payload.item.output"))
    record = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), text.alias("text"))
    shape = (
        F.when(done & (F.lower(item) == "usermessage"), record("message", "user", parts))
        .when(done & (F.lower(item) == "agentmessage"), record("message", "assistant", parts))
        .when(done & (F.lower(item) == "filechange"), record("action", "tool", changed))
        .when(noise, F.lit(None))
        .when(item == "local_shell_call", record("action", "tool", F.concat(F.lit("Ran "), command)))
        .when(item == "local_shell_call_output", record("action", "tool", output))
        .when(p == "user_message", record("message", "user", F.col("payload.message")))
        .when(p.isin("agent_message", "assistant_message"), record("message", "assistant", F.col("payload.message")))
    )
    out = e.select(
        "session_id",
        "line_no",
        "line_id",
        "source",
        "timestamp",
        shape.alias("r"),
        event_key().alias("event"),
        ignored_reason().alias("reason"),
        p.alias("_p"),
        item.alias("_item"),
        F.when(item == "local_shell_call", X.command_key(command)).alias("command_key"),
        F.when(item == "local_shell_call_output", F.sha2(output, 256)).alias("output_key"),
    )
    said = F.when(F.col("r.text").rlike(r"[^\s]"), F.col("r"))
    out = out.withColumn("r", said)
    demoted = (F.col("r.role") == "user") & (
        CX.is_service_context("r.text") | (~F.lower("_item").eqNullSafe("usermessage") & (F.col("_p") != "user_message") & CX.is_injected_context("r.text"))
    )
    out = out.withColumn("_note", F.coalesce(demoted, F.lit(False)))
    kind, role, kept = F.when(F.col("_note"), "note").otherwise(F.col("r.kind")), F.when(F.col("_note"), "system").otherwise(F.col("r.role")), F.col("r").isNotNull()
    return out.select(
        "session_id", "line_no", "line_id", "source", "timestamp", "event", "reason",
        F.when(kept, "recognized").when(F.col("reason") == "unrecognized_schema", "unknown").otherwise("ignored").alias("status"),
        kind.alias("kind"), role.alias("role"), F.col("r.text").alias("text"), F.when(F.col("_note"), "injected_context").otherwise(F.col("event")).alias("source_type"),
        F.when(kept, F.col("command_key")).alias("command_key"), F.when(kept, F.col("output_key")).alias("output_key"),
    )


def records(lines: DataFrame) -> DataFrame:
    """session_id, line_no, line_id, source, timestamp, kind, role, text, source_type, command_key, output_key of every event
    that gives a record; kind is message, action or note.  Blank texts give none."""
    return classified(lines).where("status = 'recognized'").drop("event", "reason", "status")


def with_turns(rows: DataFrame) -> DataFrame:
    """Records with turn_no: the number of user messages so far in the session; 0 before the first."""
    prompt = F.when((F.col("kind") == "message") & (F.col("role") == "user"), 1).otherwise(0).cast("bigint")
    # a running step reads its rows twice: they are classified once
    return running(materialize(rows, "turns"), ["session_id"], "line_no", {"turn_no": ("sum", prompt)})
