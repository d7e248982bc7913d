"""The index of user turns: prompts that reach the log on several surfaces count once.

A prompt is the same turn as an earlier one if they share an item id and their text and do not name different turns, or if
it repeats the last turn's text on another surface with no activity between.  A turn's id is the one its prompt names, else
the one announced before it, else the first announced after it and before any activity; activity ends an announcement.

What a turn is depends on the turns before it, so a session is folded in order.  The fold sees prompts and announcements
only: activity between them is a running count, taken before, on skew-safe blocks.  Its rows hold hashes and ids, no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlog.operators.running import running
from loomlog.storage import materialize

TURNS = "session_id string, turn_no bigint, line_no bigint, turn_id string, item_ids array<string>, text_sha256 string, surface string, duplicate_lines array<bigint>"
_NAMES = [c.split()[0] for c in TURNS.split(", ")]


class _Session:
    """Turns of one session so far."""

    def __init__(self, name: str | None):
        self.name, self.turns, self.by_id = name, [], {}
        self.surfaces: set[str] = set()
        self.active_at, self.announced, self.announced_at = 0, "", 0

    def announce(self, given: str, active: int, context: bool) -> None:
        last = self.turns[-1] if self.turns else None
        if context and given and last and active == self.active_at and last["turn_id"] in ("", given):
            last["turn_id"], given = given, ""
        self.announced, self.announced_at = given, active

    def prompt(self, line: int, text: str, surface: str, turn_id: str, ids: list[str], active: int) -> None:
        effective = turn_id or (self.announced if self.announced_at == active else "")
        fits = lambda t, named: not named or t["turn_id"] in ("", named)
        known = (self.by_id[i] for i in ids if i in self.by_id)
        at = next((k for k in known if self.turns[k]["text_sha256"] == text and fits(self.turns[k], turn_id)), None)
        if at is None and self.turns and active == self.active_at and surface not in self.surfaces:
            last = self.turns[-1]
            at = len(self.turns) - 1 if last["text_sha256"] == text and fits(last, effective) else None
        if at is None:
            at = len(self.turns)
            self.turns.append({"line_no": line, "turn_id": effective, "item_ids": list(ids), "text_sha256": text, "surface": surface, "duplicate_lines": []})
            self.surfaces, self.active_at, self.announced = {surface}, active, ""
        else:
            turn = self.turns[at]
            turn["item_ids"] = list(dict.fromkeys([*turn["item_ids"], *ids]))
            turn["turn_id"] = turn_id or turn["turn_id"]
            turn["duplicate_lines"].append(line)
            if at == len(self.turns) - 1:
                self.surfaces.add(surface)
        self.by_id |= dict.fromkeys(ids, at)


def _batch(done: list[_Session]) -> pa.RecordBatch:
    rows = [(s.name, k, t) for s in done for k, t in enumerate(s.turns, 1)]
    types = {"line_no": pa.int64(), "item_ids": pa.list_(pa.string()), "duplicate_lines": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][c] for r in rows], types.get(c, pa.string())) for c in _NAMES[2:])], names=_NAMES
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions one after another, as the rows are sorted; a session is given out when the next one begins."""
    now = None
    for b in batches:
        done = []
        columns = (b.column(c).to_pylist() for c in ("session_id", "line_no", "prompt", "surface", "turn_id", "item_ids", "active", "given", "context"))
        for name, line, prompt, surface, turn_id, ids, active, given, context in zip(*columns):
            if now is None or now.name != name:
                done += [now] if now else []
                now = _Session(name)
            if given is not None:
                now.announce(given, active, context)
            if prompt is not None:
                now.prompt(line, prompt, surface, turn_id or "", ids or [], active)
        if done:
            yield _batch(done)
    if now:
        yield _batch([now])


def turn_index(classified: DataFrame) -> DataFrame:
    """TURNS of classified lines (see operators/classify.py); injected context gives no turn and is no activity."""
    prompt = F.col("surface").isNotNull() & ~F.coalesce("injected", F.lit(False))
    acts = F.coalesce("activity", F.lit(False)) & F.col("surface").isNull()
    rows = classified.where("status in ('recognized', 'ignored')").select(
        "session_id", "line_no", F.when(prompt, F.col("prompt_sha256")).alias("prompt"), "surface", "turn_id", "item_ids",
        F.col("given_turn").alias("given"), F.col("event").startswith("turn_context/").alias("context"), acts.cast("bigint").alias("acts"),
    )
    rows = materialize(rows.where("prompt is not null or given is not null or acts > 0"), "signals")
    rows = running(rows, ["session_id"], "line_no", {"active": ("sum", F.col("acts"))}).where("prompt is not null or given is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "line_no").mapInArrow(_fold, TURNS)
