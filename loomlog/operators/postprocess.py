"""Records as a reader sees them: repeats dropped, commands joined with their outputs, a summary before each block of actions.

The order of the steps is part of the result: commands repeated among the last kept ones (unless they carry an output), outputs
repeated among the last kept ones, noise cards, first-in-first-out pairing, block summaries.  What is kept depends on what
was kept, so a session is folded in order, over narrow rows: keys, counts and line numbers.  Texts are joined afterwards.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlog.functions.extract import FILE_LABELS, plural
from loomlog.operators.folds import fold_sorted
from loomlog.storage import materialize

#: Look-back of the repeat filters: kept commands and kept outputs.
RECENT_COMMANDS, RECENT_OUTPUTS = 12, 3
# Cards that say nothing, and the output that only repeats a patch's files.
NOISE_CARDS = ["Action `apply_patch`", "Action `patch_apply_end`", "Action `tool`"]
PATCH_ECHO = "Success. Updated the following files:"

FOLDED = "session_id string, position bigint, command_line bigint, output_line bigint, summary string, source_lines array<bigint>"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]


def block_summary(created: int, edited: int, deleted: int, commands: int) -> str:
    """What a block of actions did, in one sentence; empty if it did nothing that counts."""
    verbs = [label.split()[0] for label in FILE_LABELS.values()]
    files = [plural(n, verb, "file") for n, verb in zip((created, edited, deleted), verbs) if n]
    return ", ".join(files + [plural(commands, "ran" if files else "Ran", "command")] * bool(commands))


@dataclass
class _Session:
    name: str | None
    commands: deque = field(default_factory=lambda: deque(maxlen=RECENT_COMMANDS))
    outputs: deque = field(default_factory=lambda: deque(maxlen=RECENT_OUTPUTS))
    pending: deque = field(default_factory=deque)
    block: list = field(default_factory=list)
    position: int = 0

    def fresh(self, action: bool, command: str | None, output: str | None, noise: bool) -> bool:
        """The repeat and noise filters, which remember what passes them."""
        if action and command:
            if command in self.commands and not output:
                return False
            self.commands.append(command)
        if action and output:
            if output in self.outputs:
                return False
            self.outputs.append(output)
        return not noise

    def emit(self, *row) -> tuple:
        self.position += 1
        return (self.name, self.position, *row)

    def close(self) -> list[tuple]:
        """The block of actions so far, behind its summary."""
        if not self.block:
            return []
        summary = block_summary(*(sum(counts[k] for _, _, counts in self.block) for k in range(4)))
        lines = sorted({n for a, b, _ in self.block for n in (a, b) if n is not None})
        out = [self.emit(None, None, summary, lines)] if summary else []
        out += [self.emit(a, b, None, [n for n in (a, b) if n is not None]) for a, b, _ in self.block]
        self.block = []
        return out

    def flush(self) -> None:
        """Commands that got no output stand by themselves."""
        self.block += [(line, None, counts) for line, counts in self.pending]
        self.pending.clear()


def _step(s: _Session, row: tuple) -> list[tuple]:
    _, line, action, command, output, noise, *counts = row
    if not s.fresh(action, command, output, noise):
        return []
    if action and command and not output:
        s.pending.append((line, counts))
        return []
    if action and output and not command and s.pending:
        first, own = s.pending.popleft()
        # the pair stands under the command, so its text begins as the command's does
        s.block.append((first, line, [a + b for a, b in zip(own[:3], counts[:3])] + [own[3]]))
        return []
    s.flush()
    if action:
        s.block.append((line, None, counts))
        return []
    return [*s.close(), s.emit(line, None, None, [line])]


def _end(s: _Session) -> list[tuple]:
    s.flush()
    return s.close()


def narrow(records: DataFrame) -> DataFrame:
    """What the fold needs of a record."""
    cards = lambda label: F.regexp_count("text", F.lit(f"(?m)^{label}$")).cast("int")
    action = F.col("kind") == "action"
    noise = action & (F.trim("text").isin(NOISE_CARDS) | (F.col("command_key").isNull() & F.contains("text", F.lit(PATCH_ECHO))))
    key = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.xxhash64(c).cast("string"))
    command = action & (F.col("command_key").isNotNull() | F.col("text").startswith("Ran "))
    return records.select(
        "session_id", "line_no", action.alias("action"), key("command_key").alias("command"), key("output_key").alias("output"), F.coalesce(noise, F.lit(False)).alias("noise"),
        *(cards(label).alias(op) for op, label in FILE_LABELS.items()), command.cast("int").alias("ran"),
    )


def fold(records: DataFrame) -> DataFrame:
    """FOLDED: rows in order; a summary, or the line of a record and of the output that joined it."""
    return fold_sorted(narrow(records), ["session_id"], ["line_no"], FOLDED, _TYPES, lambda key: _Session(key[0]), _step, _end)


def post_processed(records: DataFrame) -> DataFrame:
    """session_id, position, kind, role, source_type, timestamp, text, command_key, output_key, source_lines."""
    records = materialize(records.select("session_id", "line_no", "kind", "role", "source_type", "timestamp", "text", "command_key", "output_key"), "records")
    rows = materialize(fold(records), "folded")
    own = records.select(F.col("session_id").alias("s"), F.col("line_no").alias("n"), "kind", "role", "source_type", "timestamp", "text", "command_key", "output_key")
    out = own.select(F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("text").alias("answer"), F.col("output_key").alias("answer_key"))
    whole = rows.where("summary is null").join(own, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("command_line") == F.col("n")))
    alone, pairs = whole.where("output_line is null"), whole.where("output_line is not null")
    pairs = pairs.join(out, F.col("session_id").eqNullSafe(F.col("s2")) & (F.col("output_line") == F.col("n2")))
    pairs = pairs.withColumn("text", F.trim(F.concat_ws("\n\n", F.rtrim("text"), F.rtrim("answer")))).withColumn("output_key", F.col("answer_key"))
    columns = ["session_id", "position", "kind", "role", "source_type", "timestamp", "text", "command_key", "output_key", "source_lines"]
    none = F.lit(None).cast("string")
    notes = rows.where("summary is not null").select(
        "session_id", "position", F.lit("note").alias("kind"), F.lit("system").alias("role"), F.lit("summary").alias("source_type"), none.alias("timestamp"), F.col("summary").alias("text"),
        none.alias("command_key"), none.alias("output_key"), "source_lines",
    )
    return alone.select(columns).unionByName(pairs.select(columns)).unionByName(notes)
