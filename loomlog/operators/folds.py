"""Folds over sorted rows in constant memory: what depends on everything before it in a group, one row after another.

Rows are shuffled by group and sorted on disk by Spark; Python sees batches and keeps the state of one group only.  A group is
one task's work, however large: callers keep the rows narrow."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], schema: str, types: list[pa.DataType], begin: Callable, step: Callable, end: Callable) -> DataFrame:
    """begin(key) gives a state, step(state, row) rows to emit, end(state) the last ones.  Rows are tuples of all columns."""
    names = [c.split()[0] for c in schema.split(", ")]
    at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = tuple(row[k] for k in at)
                if state is None or key != now:
                    out += end(state) if state is not None else []
                    now, state = key, begin(key)
                out += step(state, row)
            yield _batch(out, names, types)
        if state is not None:
            yield _batch(list(end(state)), names, types)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def ordered_sha256(rows: DataFrame, keys: dict[str, pa.DataType], order: list[str], data: str) -> DataFrame:
    """keys, sha256 of the binary column data of each group in order, hashed as it streams by."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sha256 string"

    def step(state: tuple, row: tuple) -> list:
        state[1].update(row[-1])
        return []

    narrow = rows.select(*keys, *order, data)
    return fold_sorted(narrow, list(keys), order, schema, [*keys.values(), pa.string()], lambda key: (key, hashlib.sha256()), step, lambda s: [(*s[0], s[1].hexdigest())])
