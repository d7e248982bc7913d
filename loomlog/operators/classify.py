"""Raw JSON event lines to classified events, in one Arrow-batched pass without a shuffle.

Events have no fixed schema, so a line is parsed (tolerantly) and offered to RULES in order; the first that gives a record
with text wins.  The pass also gives what the turn index needs (user signals, activity, turn ids) and the audits (parse
status, ignored reasons, counts of cleaning steps), so that no query reads or joins the lines twice.

Defined results for odd input: blank lines are ``blank``; lines that are no JSON object are ``error``, with hash, preview and
error; events that give no record are ``ignored`` with a reason; null lines count as blank.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import extract as E
from loomlog.functions.context import injected_context, service_context
from loomlog.operators import records as R
from loomlog.operators.texts import parse_object

# Type names of messages, and parts of type names that mark tool activity.
MESSAGE_TYPES = ["message", "user_message", "assistant_message", "agent_message", "system_message"]
ACTION_HINTS = ["tool", "function", "shell", "command", "exec", "apply_patch", "patch", "edit", "write_stdin", "call", "local_shell", "browser"]
SPEAKERS = ["user", "assistant", "system"]
QUIET_TOPS = ["session_meta", "turn_context", "token_usage_record", "compacted", "world_state"]
QUIET_PAYLOADS = ["token_count", "task_started", "task_complete", "turn_started", "turn_complete"]


@dataclass
class Options:
    """actions: also tool activity; reasoning: also explicit summaries of reasoning (raw reasoning never); tool_outputs and
    most_characters: see extract.by_policy."""

    actions: bool = True
    reasoning: bool = False
    tool_outputs: str = "full"
    most_characters: int = 20_000


@dataclass
class Event:
    value: dict
    options: Options
    counts: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        sub = lambda d, k: d[k] if isinstance(d.get(k), dict) else {}
        self.payload = sub(self.value, "payload")
        self.item = sub(self.payload, "item")
        self.top, self.ptype, self.itype = (str(d.get("type") or "") for d in (self.value, self.payload, self.item))
        self.blob = f"{self.top} {self.ptype} {self.itype}".lower()

    @property
    def completed(self) -> str:
        """Lower-cased type of the item that an item_completed event carries, else nothing."""
        return self.itype.casefold() if self.item and (self.top, self.ptype) == ("event_msg", "item_completed") else ""

    def first_text(self, holder: dict, *keys: str) -> str:
        return E.text_of(next((v for k in keys if (v := holder.get(k))), None), counts=self.counts)

    def action(self, holder: dict) -> tuple[str, str, str]:
        output, meta = E.output_of(holder, self.counts)
        return E.action_card(E.command_of(holder), E.by_policy(output, self.options.tool_outputs, self.options.most_characters), meta)


@dataclass
class Record:
    kind: str
    role: str
    text: str
    source_type: str
    command_key: str = ""
    output_key: str = ""


def _hinted(name: str) -> bool:
    return any(h in name for h in ACTION_HINTS)


def _reasoning(e: Event) -> Record | None:
    holder = e.item if e.itype.casefold() == "reasoning" else e.payload
    if e.options.reasoning and "reasoning" in (e.itype.casefold(), e.ptype.casefold()):
        if said := E.text_of(holder.get("summary") or holder.get("summary_text"), True):
            return Record("note", "assistant", f"Reasoning summary (explicit; opt-in)\n\n{said}", "reasoning_summary")
    return None


def _completed_message(e: Event) -> Record | None:
    if role := {"usermessage": "user", "agentmessage": "assistant"}.get(e.completed):
        return Record("message", role, e.first_text(e.item, "content", "text", "message"), e.itype)
    return None


def _as_json(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _completed_activity(e: Event) -> Record | None:
    kind = e.completed if e.options.actions else ""
    if kind == "filechange":
        parts = [f"File change status: {e.item.get('status', 'unknown')}"]
        for path, change in e.item["changes"].items() if isinstance(e.item.get("changes"), dict) else ():
            parts.append(f"File: {path}")
            if isinstance(change, dict):
                parts.append(f"Change type: {change.get('type', 'unknown')}")
                parts += [f"{k}:\n{_as_json(v)}" for k, v in change.items() if k != "type"]
            else:
                parts.append(_as_json(change))
        parts += [f"{k}:\n{e.item[k]}" for k in ("stdout", "stderr") if e.item.get(k)]
        return Record("action", "tool", "\n\n".join(parts), e.itype)
    if kind in ("extension", "mcptoolcall"):
        head = "Extension activity" if kind == "extension" else "MCP tool item"
        return Record("action", "tool", f"{head}\n\n{json.dumps(e.item, ensure_ascii=False, indent=2)}", e.itype)
    if kind == "imageview" and e.item.get("path"):
        return Record("note", "tool", f"Image viewed (external file reference, image bytes not embedded): {e.item['path']}", e.itype)
    return None


def _item(e: Event) -> Record | None:
    role = str(e.item.get("role") or "")
    if e.itype in MESSAGE_TYPES and role in SPEAKERS:
        if said := e.first_text(e.item, "content", "message", "text"):
            return Record("message", role, said, e.itype)
    if e.item and e.options.actions and _hinted(e.itype.lower()):
        text, command, output = e.action(e.item)
        return Record("action", "tool", text, e.itype, command, output)
    return None


def _spoken(e: Event) -> Record | None:
    if e.ptype in ("user_message", "agent_message", "assistant_message"):
        return Record("message", "user" if e.ptype == "user_message" else "assistant", e.first_text(e.payload, "message", "text", "content"), e.ptype)
    return None


def _role_given(e: Event) -> Record | None:
    role = str(e.payload.get("role") or e.value.get("role") or "")
    if role in SPEAKERS and any(k in e.payload for k in ("text", "content", "message")):
        return Record("message", role, e.first_text(e.payload, "message", "text", "content"), e.ptype or e.top)
    return None


def _activity(e: Event) -> Record | None:
    if e.options.actions and _hinted(e.blob):
        text, command, output = e.action(e.payload or e.value)
        return Record("action", "tool", text, e.ptype or e.top, command, output)
    return None


def _media_prompt(e: Event) -> Record | None:
    signal = E.signal_of(e.value)
    return Record("message", "user", signal.text, e.ptype or e.top) if signal else None


#: In order of precedence; noise stops the search before the rules behind it.
BEFORE_NOISE: list[Callable[[Event], Record | None]] = [_reasoning, _completed_message, _completed_activity]
BEHIND_NOISE: list[Callable[[Event], Record | None]] = [_item, _spoken, _role_given, _activity, _media_prompt]


def record_of(e: Event) -> Record | None:
    """The record of an event.  A user message that is service or injected context as a whole becomes a note of the system;
    explicit user events are believed not to be injected."""
    noisy = any(h in e.blob for h in R.NOISE)
    for rule in BEFORE_NOISE if noisy else [*BEFORE_NOISE, *BEHIND_NOISE]:
        if (r := rule(e)) is not None and r.text:
            if (r.kind, r.role) == ("message", "user"):
                explicit = r.source_type.casefold() in ("user_message", "usermessage")
                if service_context(r.text) or (not explicit and injected_context(r.text)):
                    return Record("note", "system", r.text, "injected_context")
            return r
    return None


def is_activity(e: Event) -> bool:
    """Whether an event comes between turns: something was said or done, not only recorded."""
    if e.top.casefold() in QUIET_TOPS or e.ptype.casefold() in QUIET_PAYLOADS or (e.ptype.casefold(), e.itype.casefold()) == ("item_started", "usermessage"):
        return False
    role = str(e.payload.get("role") or e.item.get("role") or e.value.get("role") or "").casefold()
    if role in ("system", "developer"):
        return False
    return e.top.casefold() in ("response_item", "event_msg") or bool(e.item) or bool(e.payload.get("role") or e.value.get("role"))


def given_turn(e: Event) -> str | None:
    """The turn id that a context or start event announces ('' where it names none); None for other events."""
    if e.top.casefold() == "turn_context":
        return str(e.payload.get("turn_id") or e.payload.get("id") or "")
    if e.ptype.casefold() in ("task_started", "turn_started"):
        return str(e.payload.get("turn_id") or "")
    return None


def history_of(e: Event) -> tuple[str | None, bool]:
    """(kind, whether earlier records are replaced) of an event that changes the history; (None, False) for others."""
    low = [x.casefold() for x in (e.top, e.ptype, e.itype)]
    replaced = any("replacement_history" in d for d in (e.value, e.payload, e.item))
    whole = replaced or low[0] == "compacted" or "contextcompaction" in low[1:]
    if whole or low[1] in ("thread_rolled_back", "context_compacted"):
        return "replacement_history" if replaced else low[1] or low[2] or low[0], whole
    return None, False


CLASSIFIED = (
    "session_id string, line_no bigint, status string, event string, reason string, timestamp string, kind string, role string, text string, "
    "source_type string, command_key string, output_key string, surface string, prompt_sha256 string, turn_id string, item_ids array<string>, "
    "injected boolean, activity boolean, given_turn string, history string, replaces boolean, repairs int, error string, raw_sha256 string, "
    "raw_preview string, counts map<string,bigint>"
)
_COLUMNS = [c.split()[0] for c in CLASSIFIED.split(", ")]


def classify_line(raw: str | None, options: Options) -> dict:
    """All columns of one line but its key; what does not apply is missing."""
    parsed = parse_object(raw)
    if parsed.value is None:
        if parsed.status == "blank":
            return {"status": "blank"}
        data = raw.encode("utf-8", "replace")
        return {"status": "error", "error": parsed.error, "raw_sha256": hashlib.sha256(data).hexdigest(), "raw_preview": raw[:240]}
    e = Event(parsed.value, options)
    r = record_of(e)
    out = {
        "status": "recognized" if r else "ignored",
        "event": "/".join(x or "-" for x in (e.top, e.ptype, e.itype)),
        "reason": None if r else ignored_reason(e),
        "timestamp": E.event_time(e.value),
        "activity": is_activity(e),
        "given_turn": given_turn(e),
        "repairs": parsed.repairs,
        "error": parsed.error,
        "counts": [(k, n) for k, n in e.counts.items() if n],
    }
    out["history"], out["replaces"] = history_of(e)
    if r:
        out |= {"kind": r.kind, "role": r.role, "text": r.text, "source_type": r.source_type, "command_key": r.command_key or None, "output_key": r.output_key or None}
    if s := E.signal_of(e.value):
        injected = service_context(s.text) or (s.surface in ("response_item/message", "generic/user") and injected_context(s.text))
        out |= {"surface": s.surface, "prompt_sha256": hashlib.sha256(s.text.encode("utf-8", "replace")).hexdigest(), "turn_id": s.turn_id, "item_ids": s.item_ids, "injected": injected}
    return out


def ignored_reason(e: Event) -> str:
    """Why an event gives no record: R.REASONS in order."""
    kind = (e.itype if e.ptype in ("item_completed", "item_started", "item_updated") else e.ptype).casefold()
    reasons = {
        "tool_catalog_metadata": e.top == "response_item" and kind == "additional_tools",
        "telemetry_token_count": e.top == "token_usage_record" or kind == "token_count",
        "raw_reasoning_not_exported": kind == "agent_reasoning",
        "reasoning_summary_empty": kind == "reasoning" and e.options.reasoning,
        "reasoning_summary_opt_in_disabled": kind == "reasoning",
        "metadata_only": e.top in ("turn_context", "session_meta", "world_state"),
        "context_history_event": e.completed == "contextcompaction" or e.top == "compacted" or kind in ("context_compacted", "thread_rolled_back"),
        "lifecycle_event": kind in R.LIFECYCLE,
        "unsupported_tool_lifecycle_or_specialized_event": kind in R.SPECIAL,
        "known_response_item_not_rendered_or_duplicate": e.top == "response_item" and kind in R.KNOWN_ITEMS,
        "runtime_error_event": e.top == "event_msg" and kind == "error",
    }
    return next((k for k, holds in reasons.items() if holds), "unrecognized_schema")


_TYPES = {"line_no": pa.int64(), "item_ids": pa.list_(pa.string()), "injected": pa.bool_(), "activity": pa.bool_(), "replaces": pa.bool_(), "repairs": pa.int32(), "counts": pa.map_(pa.string(), pa.int64())}


def classify(lines: DataFrame, options: Options | None = None, with_text: bool = True) -> DataFrame:
    """CLASSIFIED of lines with session_id, line_no and raw (a JSON text); without text only its place is left out."""
    options = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [classify_line(t, options) for t in b.column("raw").to_pylist()]
            own = [b.column("session_id"), b.column("line_no")]
            rest = [pa.array([None if c == "text" and not with_text else r.get(c) for r in rows], _TYPES.get(c, pa.string())) for c in _COLUMNS[2:]]
            yield pa.RecordBatch.from_arrays([*own, *rest], names=_COLUMNS)

    return lines.select("session_id", "line_no", "raw").mapInArrow(run, CLASSIFIED)


def as_json(rows: DataFrame, *key: Column) -> DataFrame:
    """Typed event rows as the JSON lines they came from; null fields are left out."""
    return rows.select(*key, F.to_json(F.struct("timestamp", "type", "payload")).alias("raw"))


def strict(classified: DataFrame) -> DataFrame:
    """The same rows, or an error where a line is no JSON object: exact indexing must not skip any."""
    bad = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" cannot be parsed: "), F.coalesce("error", F.lit("?"))))
    return classified.withColumn("status", F.when(F.col("status") == "error", bad.cast("string")).otherwise(F.col("status")))
