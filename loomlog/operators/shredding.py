"""Columnar shredding of nested records and reconstruction of flat, linked tables.

A leaf path is striped into (repetition level, definition level, value) triples straight from Arrow offsets and
validity, without a Python loop over rows.  The table of a repeated ancestor is then rebuilt from the level
sequences alone: a slot of repetition level 0 starts a record, level r continues the list of depth r.

Defined results for odd input: null and empty lists give no rows; null elements give no rows but count as positions;
null leaves stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _valid(a: pa.Array) -> np.ndarray:
    return np.asarray(a.is_valid().to_numpy(zero_copy_only=False), dtype=bool)


class Stripe:
    """Levels of one leaf path.  defined[k]: the definition level from which on the k-th repeated ancestor has an element."""

    def __init__(self, column: pa.Array, path: list[str]):
        n = len(column)
        rep, deep, index, live = np.zeros(n, np.int32), np.zeros(n, np.int32), np.arange(n), np.ones(n, bool)
        self.max_rep, self.max_def, self.defined = 0, 0, []
        node, steps = column, list(path)
        while True:
            valid = np.zeros(len(index), bool)
            valid[live] = _valid(node)[index[live]] if len(node) else False
            live = live & valid
            deep = deep + live
            self.max_def += 1
            if pa.types.is_list(node.type) or pa.types.is_large_list(node.type):
                offsets = np.asarray(node.offsets)
                start, size = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
                start[live] = offsets[index[live]]
                size[live] = offsets[index[live] + 1] - start[live]
                times = np.maximum(size, 1)
                first = np.zeros(int(times.sum()), bool)
                first[np.cumsum(times) - times] = True
                self.max_rep += 1
                inner = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
                rep = np.where(first, np.repeat(rep, times), self.max_rep)
                live = np.repeat(live & (size > 0), times)
                deep = np.repeat(deep, times) + live
                index = np.repeat(start, times) + inner
                self.max_def += 1
                self.defined.append(self.max_def + 1)  # the element itself is optional
                node = node.values
            elif pa.types.is_struct(node.type) and steps:
                node = node.field(steps.pop(0))
            else:
                break
        self.rep, self.deep, self.index, self.leaf = rep, deep, index, node
        self.has_value = live

    def values(self, rows: np.ndarray) -> pa.Array:
        """Leaf values of slots; null where the path ends above the leaf."""
        return self.leaf.take(pa.array(np.where(self.has_value, self.index, 0)[rows], mask=~self.has_value[rows])) if len(self.leaf) else pa.nulls(len(rows), self.leaf.type)

    def positions(self) -> list[np.ndarray]:
        """For each slot its record and, for each repeated ancestor, its place in that list; from the levels alone."""
        slot = np.arange(len(self.rep))
        out = [np.cumsum(self.rep == 0) - 1]
        for depth in range(1, self.max_rep + 1):
            starts, moves = self.rep < depth, self.rep <= depth
            begun = np.maximum.accumulate(np.where(starts, slot, -1)) if len(slot) else slot
            count = np.cumsum(moves)
            out.append(count - count[begun] if len(slot) else slot)
        return out

    def elements(self, depth: int) -> np.ndarray:
        """Slots that begin a non-null element of the depth-th repeated ancestor."""
        return np.flatnonzero((self.rep <= depth) & (self.deep >= self.defined[depth - 1]))


def shred(df: DataFrame, key: str, column: str, depth: int, fields: list[str], inner: list[str]) -> DataFrame:
    """Flat table of the depth-th repeated level below column: key, pos_1..pos_depth and the scalar fields of the level.

    inner holds the struct fields that lead from one repeated level to the next.  df needs key and column only; rows
    without a list stay in the JVM."""
    path = inner[: depth - 1]
    source = df.select(F.col(key).alias("record_id"), F.col(column).alias("tree")).where("size(tree) > 0")
    schema = "record_id bigint, " + ", ".join(f"pos_{k + 1} int" for k in range(depth)) + "".join(f", {f} string" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stripes = {f: Stripe(b.column("tree"), [*path, f]) for f in fields}
            s = next(iter(stripes.values()))
            rows, at = s.elements(depth), s.positions()
            yield pa.RecordBatch.from_arrays(
                [b.column("record_id").take(pa.array(at[0][rows])), *(pa.array(p[rows].astype(np.int32)) for p in at[1:]), *(stripes[f].values(rows).cast(pa.string()) for f in fields)],
                names=["record_id", *(f"pos_{k + 1}" for k in range(depth)), *fields],
            )

    return source.mapInArrow(run, schema)


def entries(lines: DataFrame) -> DataFrame:
    """Non-null replacement-history entries with their line and position."""
    return shred(lines, "line_id", "payload.replacement_history", 1, ["type", "role"], ["content"]).selectExpr(
        "record_id as line_id", "pos_1 as entry_pos", "type", "role"
    )


def parts(lines: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("type", "text")) -> DataFrame:
    """Non-null content parts of both tables with their record, entry and position, and the wanted fields."""
    deep = shred(lines, "line_id", "payload.replacement_history", 2, list(fields), ["content"])
    flat = shred(items, "item_id", "payload.content", 1, list(fields), [])
    return deep.selectExpr("'rollout_lines' as table_name", "record_id", "pos_1 as entry_pos", "pos_2 as part_pos", *fields).unionByName(
        flat.selectExpr("'response_items' as table_name", "record_id", "0 as entry_pos", "pos_1 as part_pos", *fields)
    )
