"""Order-sensitive operators over records and events, on skew-safe running aggregates."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomlog.operators.folds import fold_sorted
from loomlog.operators.postprocess import RECENT_COMMANDS, RECENT_OUTPUTS
from loomlog.operators.records import events
from loomlog.operators.running import running, running_floor
from loomlog.storage import materialize



def numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows numbered from 1 in order."""
    return running(rows, keys, order, {name: ("sum", F.lit(1).cast("bigint"))})


def asof(rows: DataFrame, event: Column, probe: Column) -> DataFrame:
    """Backward, strict as-of join: for each probe row the line of the last event before it."""
    found = running(rows.select("session_id", "line_no", event.alias("e"), probe.alias("p")), ["session_id"], "line_no", {"context_line": ("max", F.when(F.col("e"), F.col("line_no")))}, before_only=True)
    return found.where("p").select("session_id", "line_no", "context_line")


def without_adjacent_repeats(records: DataFrame) -> DataFrame:
    """Drops rows equal to the row before them in kind, role and text.

    A repeated user message stays if it has the source type of the first of its run: the comparison is with the last
    row kept, which is the first of the run."""
    same = F.xxhash64("kind", "role", "text")
    rows = records.withColumn("_hash", same)
    rows = running(rows, ["session_id"], "line_no", {"_last": ("max", F.struct("line_no", "_hash"))}, before_only=True)
    rows = rows.withColumn("_fresh", F.coalesce(F.col("_last._hash") != F.col("_hash"), F.lit(True)))
    rows = running(rows, ["session_id"], "line_no", {"_first": ("max", F.when(F.col("_fresh"), F.struct("line_no", "source_type")))})
    again = (F.col("kind") == "message") & (F.col("role") == "user") & F.col("source_type").eqNullSafe(F.col("_first.source_type"))
    return rows.where(F.col("_fresh") | again).drop("_hash", "_last", "_fresh", "_first")


def _plural(n: str, verb: str, what: str) -> Column:
    c = F.col(n)
    return F.when(c > 0, F.concat(F.lit(f"{verb} "), c, F.lit(f" {what}"), F.when(c == 1, "").otherwise("s")))


def action_blocks(records: DataFrame) -> DataFrame:
    """Contiguous runs of actions of a session with counts and a summary sentence."""
    rows = running(records, ["session_id"], "line_no", {"island": ("sum", F.when(F.col("kind") == "action", 0).otherwise(1).cast("bigint"))})
    cards = lambda label: F.sum(F.regexp_count("text", F.lit(f"(?m)^{label} file$"))).cast("bigint")
    blocks = (
        rows.where("kind = 'action'")
        .groupBy("session_id", "island")
        .agg(
            F.min("line_no").alias("first_line"),
            F.count("*").alias("actions"),
            F.count_if(F.col("command_key").isNotNull() | F.col("text").startswith("Ran ")).alias("commands"),
            cards("Created").alias("created"),
            cards("Edited").alias("edited"),
            cards("Deleted").alias("deleted"),
        )
    )
    only = (F.col("created") + F.col("edited") + F.col("deleted") == 0) & (F.col("commands") > 0)
    several = F.concat_ws(", ", _plural("created", "Created", "file"), _plural("edited", "Edited", "file"), _plural("deleted", "Deleted", "file"), _plural("commands", "ran", "command"))
    return blocks.withColumn("summary", F.when(only, _plural("commands", "Ran", "command")).otherwise(several)).drop("island")


def paired(records: DataFrame) -> DataFrame:
    """First-in-first-out pairing of commands and outputs; any other record empties the queue.

    Inside a segment an output is admitted if the queue before it is not empty, which is when the running sum of
    commands less outputs is not below its least earlier value (or 0); the k-th admitted output answers the k-th command."""
    command, output = F.col("command_key").isNotNull() & (F.col("kind") == "action"), F.col("output_key").isNotNull() & (F.col("kind") == "action")
    rows = records.select("session_id", "line_no", "command_key", "output_key", command.alias("is_cmd"), output.alias("is_out"))
    # each running step reads its rows twice, so the narrow rows between steps are written once
    rows = running(materialize(rows, "pairing"), ["session_id"], "line_no", {"seg": ("sum", F.when(F.col("is_cmd") | F.col("is_out"), 0).otherwise(1).cast("bigint"))})
    keys, rows = ["session_id", "seg"], materialize(rows.where("is_cmd or is_out"), "pairing")
    rows = running_floor(rows, keys, "line_no", F.when(F.col("is_cmd"), 1).otherwise(-1).cast("bigint"))
    rows = materialize(rows.where(F.col("is_cmd") | (F.col("level") >= F.least(F.coalesce("low", F.lit(0)), F.lit(0)))), "pairing")
    one = F.lit(1).cast("bigint")
    rows = running(rows, keys, "line_no", {"nc": ("sum", F.when(F.col("is_cmd"), one)), "no": ("sum", F.when(F.col("is_out"), one))})
    rows = materialize(rows, "pairing")
    outs = rows.where("is_out").select(F.col("session_id").alias("s"), F.col("seg").alias("g"), "no", F.col("line_no").alias("output_line"), F.col("output_key").alias("ok"))
    cmds = rows.where("is_cmd").select("session_id", "seg", F.col("line_no").alias("command_line"), "command_key", "nc")
    hit = F.col("session_id").eqNullSafe(F.col("s")) & (F.col("seg") == F.col("g")) & (F.col("nc") == F.col("no"))
    return cmds.join(outs, hit, "left").select("session_id", "command_line", "output_line", "command_key", F.col("ok").alias("output_key"))


def _kept(state: tuple, row: tuple) -> list[tuple]:
    (commands, outputs), (session, line, command, output) = state, row
    if command is not None:
        if command in commands:
            return []
        commands.append(command)
    if output is not None:
        if output in outputs:
            return []
        outputs.append(output)
    return [(session, line)]


def without_recent_repeats(records: DataFrame) -> DataFrame:
    """Commands not among the last kept commands and outputs not among the last kept outputs.

    What is kept depends on what was kept, so a session is folded in order, over two hashes for each row and in constant memory."""
    rows = records.where("command_key is not null or output_key is not null")
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    narrow = rows.select("session_id", "line_no", key("command_key").alias("command"), key("output_key").alias("output"))
    begin = lambda _: (deque(maxlen=RECENT_COMMANDS), deque(maxlen=RECENT_OUTPUTS))
    return fold_sorted(narrow, ["session_id"], ["line_no"], "session_id string, line_no bigint", [pa.string(), pa.int64()], begin, _kept, lambda _: [])


def history_in_turns(rows: DataFrame) -> DataFrame:
    """Compactions and rollbacks by the turn they lie in."""
    prompt = F.when(F.col("payload.type") == "user_message", 1).otherwise(0).cast("bigint")
    rows = running(rows.select("session_id", "line_no", "type", "payload.type", prompt.alias("u")).toDF("session_id", "line_no", "type", "ptype", "u"), ["session_id"], "line_no", {"turn_no": ("sum", F.col("u"))})
    rows = rows.where("type = 'compacted' or ptype = 'thread_rolled_back'")
    return rows.groupBy("session_id", "turn_no").agg(F.count_if(F.col("type") == "compacted").alias("compactions"), F.count_if(F.col("ptype") == "thread_rolled_back").alias("rollbacks"))


def live_lines(lines: DataFrame) -> DataFrame:
    """Record lines that survive all compactions and rollbacks, and the last compaction's line with the number of prompts
    of its history that survive.

    A compaction with entries replaces everything before it by its history.  A rollback of n turns cuts at the n-th last
    prompt still there, of the history too; with fewer prompts it empties everything.  As running aggregates: with a prompt as +1 and a rollback as -n the
    number of prompts is the running sum less its least value so far (or 0); a line stays if that number never falls
    below the line's own number later, and nothing empties everything later."""
    e = events(lines)
    p = F.coalesce(F.col("payload.type"), F.lit(""))
    prompt, rolled = p == "user_message", (p == "thread_rolled_back") & (F.coalesce(F.col("payload.num_turns"), F.lit(0)) > 0)
    compacted = (F.coalesce(F.col("type"), F.lit("")) == "compacted") & (F.coalesce(F.size("payload.replacement_history"), F.lit(0)) > 0)
    item = F.coalesce(F.col("payload.item.type"), F.lit(""))
    record = p.isin("user_message", "agent_message", "assistant_message") | item.isin("local_shell_call", "local_shell_call_output", "FileChange")
    spoken = lambda h: (h["role"] == "user") & F.exists(F.coalesce(h["content"], F.array()), lambda c: F.coalesce(c["text"].rlike(r"\S"), F.lit(False)))
    asked = F.size(F.filter("payload.replacement_history", lambda h: F.coalesce(spoken(h), F.lit(False))))
    step = F.when(prompt, 1).when(rolled, -F.col("payload.num_turns")).when(compacted, asked).otherwise(0).cast("bigint")
    rows = e.select("session_id", "line_no", step.alias("step"), compacted.alias("compacted"), record.alias("record"), rolled.alias("rolled"))
    # each running step reads its rows twice, so the narrow rows between steps are written once
    rows = running(materialize(rows, "replay"), ["session_id"], "line_no", {"last": ("max", F.when(F.col("compacted"), F.col("line_no")))}, backwards=True)
    rows = rows.where("last is null or line_no = last").drop("last")  # nothing before the last compaction counts
    rows = running_floor(materialize(rows, "replay"), ["session_id"], "line_no", F.col("step")).withColumnsRenamed({"level": "s", "low": "low_before"})
    rows = materialize(rows.withColumn("low", F.least("s", "low_before")), "replay")
    rows = rows.withColumn("level", F.col("s") - F.least(F.col("low"), F.lit(0)))
    emptied = F.col("rolled") & (F.col("s") < F.least(F.coalesce("low_before", F.lit(0)), F.lit(0)))
    after = F.when(emptied, -1).when(F.col("rolled"), F.col("level"))
    rows = running(rows, ["session_id"], "line_no", {"later": ("min", after.cast("bigint"))}, before_only=True, backwards=True)
    stays = F.col("later").isNull() | (F.col("later") >= F.when(F.col("compacted"), 0).otherwise(F.col("level")))
    left = F.when(F.col("compacted"), F.least("level", "later"))
    return rows.where(stays & (F.col("record") | F.col("compacted"))).select("session_id", "line_no", left.alias("history_prompts"))


def byte_ranges(records: DataFrame) -> DataFrame:
    """Half-open byte range of each record's text in the concatenated text of its session."""
    size = F.octet_length("text").cast("bigint")
    rows = running(records.select("session_id", "line_no", size.alias("size")), ["session_id"], "line_no", {"byte_end": ("sum", F.col("size"))})
    return rows.select("session_id", "line_no", (F.col("byte_end") - F.col("size")).alias("byte_start"), "byte_end")
