"""Minimum-cost error parse of delimited records.

A record is seven fields, each free of quotes and line breaks or enclosed in quotes with inner quotes doubled.
The parse is a dynamic program over (token, automaton state, finished fields) whose edits insert or delete quotes
and delimiters at cost 1.  It runs twice: with any number of fields, where a cost above 0 means that the quoting needs
edits (``quoting``), and with seven, where a cost above 0 means that fields have to be made or joined
(``column_count``).  A plain run of the automaton goes before it and settles only the rows of cost 0, which load if
their values have their types and are rejected as ``value`` otherwise.  Edits are traced back only where they are asked for.

Defined results for odd input: a null line counts as an empty one (one empty field: column_count), a null or empty
delimiter as a comma.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = ["session_id", "timestamp", "type", "role", "content_type", "n_chars", "text"]
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_TIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]{1,6})?(?:Z|[+-]([0-9]{2}):([0-9]{2}))")
_COUNT = re.compile(r"[0-9]{1,9}")
_BAD_CHAR = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
# Fixed values of the record format.
TYPES = {"response_item", "event_msg"}
ROLES = {"user", "assistant", "system", "developer"}
CONTENT_TYPES = {"input_text", "output_text"}

START, BARE, QUOTED, CLOSED = range(4)


def is_timestamp(v: str) -> bool:
    if not (m := _TIME.fullmatch(v)):
        return False
    y, mo, d, h, mi, s, oh, om = (int(x or 0) for x in m.groups())
    try:
        date(y, mo, d)
    except ValueError:
        return False
    return h <= 23 and mi <= 59 and s <= 59 and oh <= 23 and om <= 59


def values_fit(f: list[str]) -> bool:
    return bool(
        _UUID.fullmatch(f[0])
        and is_timestamp(f[1])
        and f[2] in TYPES
        and f[3] in ROLES
        and f[4] in CONTENT_TYPES
        and _COUNT.fullmatch(f[5])
        and f[6].strip()
        and not _BAD_CHAR.search(f[6])
    )


@lru_cache(maxsize=64)
def _patterns(delim: str) -> tuple[re.Pattern, re.Pattern]:
    d = re.escape(delim)
    bare = rf'[^"\r\n{d}]' if len(delim) == 1 else rf'(?:(?!{d})[^"\r\n])'
    field = rf'(?:"(?:[^"]|"")*+"|{bare}*+)'
    return re.compile(rf"({field})({d}|\Z)"), re.compile(rf'(")|({d})|(\r\n|[\r\n])|({bare}+)')


def free_parse(line: str, delim: str) -> list[str] | None:
    """The cost-0 layer: the fields of a line whose quoting is sound, however many; None if it is broken."""
    pattern, out, at = _patterns(delim)[0], [], 0
    while True:
        if not (m := pattern.match(line, at)):
            return None
        f = m.group(1)
        out.append(f[1:-1].replace('""', '"') if f[:1] == '"' else f)
        if not m.group(2):
            return out
        at = m.end()


_NEVER = 1 << 40
_MOVES = ("", "insert-quote", "delete-quote", "insert-delimiter", "delete-delimiter")
_INSERT_QUOTE, _DELETE_QUOTE, _INSERT_DELIMITER, _DELETE_DELIMITER = range(1, 5)


def repair(line: str, delim: str, columns: int | None = len(FIELDS), trace: bool = True) -> tuple[int, list[str] | None]:
    """(cost, edits) of the cheapest way to make the line a record of so many columns, or of any number (None).

    Cells are state + 4 * finished fields; with any number of columns the fields are not counted.  Insertions lead from a
    cell to later cells only, so that one sweep settles them; uncounted, a delimiter leads back to the first cell, which
    a second sweep settles.  Edits are named kind@offset; without trace they are None and no steps are kept."""
    tokens = [(m.lastindex, m.start()) for m in _patterns(delim)[1].finditer(line)]
    last = 0 if columns is None else columns - 1
    cells, forward = 4 * (last + 1), 4 if columns else 0
    cost = [_NEVER] * cells
    cost[START] = 0
    steps: list[tuple[list[int], list[int]]] = []  # for each layer: the cell each cell came from, and by which move

    def insertions(cost: list[int]) -> None:
        came, move = list(range(cells)), [0] * cells
        for _ in range(1 if columns else 2):
            for c in range(cells):
                state, n = c & 3, cost[c] + 1
                if state == START and n < cost[c + QUOTED]:
                    cost[c + QUOTED], came[c + QUOTED], move[c + QUOTED] = n, c, _INSERT_QUOTE
                if state == QUOTED:
                    if n < cost[c + 1]:
                        cost[c + 1], came[c + 1], move[c + 1] = n, c, _INSERT_QUOTE
                elif c >> 2 < last or columns is None:
                    to = (c & ~3) + forward
                    if n < cost[to]:
                        cost[to], came[to], move[to] = n, c, _INSERT_DELIMITER
        if trace:
            steps.append((came, move))

    for kind, _ in tokens:
        insertions(cost)
        after, came, move = [_NEVER] * cells, [0] * cells, [0] * cells
        for c in range(cells):
            n = cost[c]
            if n >= _NEVER:
                continue
            state, field = c & 3, c & ~3
            if kind == 1:
                ways = [(c, n + 1, _DELETE_QUOTE)]
                if state in (START, CLOSED):
                    ways.append((field + QUOTED, n, 0))
                elif state == QUOTED:
                    ways += [(field + CLOSED, n, 0), (c, n + 1, _INSERT_QUOTE)]
            elif state == QUOTED:
                ways = [(c, n, 0)]
            elif kind == 2:
                ways = [(c, n + 1, _DELETE_DELIMITER)]
                if c >> 2 < last or columns is None:
                    ways.append((field + forward, n, 0))
            else:
                ways = [(field + BARE, n, 0)] if kind == 4 and state != CLOSED else []
            for to, total, how in ways:
                if total < after[to]:
                    after[to], came[to], move[to] = total, c, how
        cost = after
        if trace:
            steps.append((came, move))
    insertions(cost)
    at = min((4 * last + s for s in (START, BARE, CLOSED)), key=lambda c: cost[c])
    if not trace:
        return cost[at], None
    best, edits = cost[at], []
    for layer in range(len(steps) - 1, -1, -1):
        came, move = steps[layer]
        offset = tokens[layer // 2][1] if layer // 2 < len(tokens) else len(line)
        while move[at]:
            edits.append(f"{_MOVES[move[at]]}@{offset}")
            at = came[at]
            if layer % 2:  # a token is passed in one step; insertions before it may follow each other
                break
        else:
            at = came[at]
    return best, edits[::-1]


def parse_line(line: str | None, delim: str | None, trace: bool = True) -> tuple[list[str] | None, str | None, int, str | None]:
    """(fields of a row that loads, reason of one that does not, cost, edits)."""
    line, delim = line or "", delim or ","
    fields = free_parse(line, delim)
    if fields is not None and len(fields) == len(FIELDS):  # nothing to edit
        return (fields, None, 0, None) if values_fit(fields) else (None, "value", 0, None)
    cost, edits = repair(line, delim, None, trace)
    if cost:
        reason = "quoting"
        if trace:
            cost, edits = repair(line, delim)
    else:
        cost, edits = repair(line, delim, len(FIELDS), trace)
        reason = "column_count"
    return None, reason, cost, ";".join(edits) if trace else None


PARSED = "raw_id bigint, file_name string, " + ", ".join(f"{f} string" for f in FIELDS) + ", reason string, cost int, edits string"


def _batches(batches: Iterator[pa.RecordBatch], trace: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [parse_line(x, d, trace) for x, d in zip(b.column("raw_line").to_pylist(), b.column("delim").to_pylist())]
        columns = [pa.array([r[0][k] if r[0] else None for r in rows], pa.string()) for k in range(len(FIELDS))]
        yield pa.RecordBatch.from_arrays(
            [b.column("raw_id"), b.column("file_name"), *columns, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())],
            names=["raw_id", "file_name", *FIELDS, "reason", "cost", "edits"],
        )


def parse(raw: DataFrame, trace: bool = True) -> DataFrame:
    """One row for each raw row: its seven fields, or the reason, the cost and (with trace) the edits.  No shuffle.

    Without trace the cost is that of the run that gave the reason."""
    return raw.select("raw_id", "file_name", "delim", "raw_line").mapInArrow(partial(_batches, trace=trace), PARSED)


def loaded(raw: DataFrame) -> DataFrame:
    """The rows that load, typed."""
    return parse(raw, trace=False).where("reason is null").selectExpr(
        "raw_id", "file_name", "session_id", "to_timestamp(timestamp) as timestamp", "type", "role", "content_type", "cast(n_chars as bigint) as n_chars", "text"
    )


def reasons(raw: DataFrame) -> DataFrame:
    """The rows that do not load, with the reason."""
    return parse(raw, trace=False).where("reason is not null").select("raw_id", "reason")


def rejected(raw: DataFrame) -> DataFrame:
    """The rows that do not, with the reason and the cheapest repair."""
    return parse(raw).where("reason is not null").select("raw_id", "file_name", "reason", "cost", "edits")
