"""Operators on texts that need more than one expression: runs of equal lines, tolerant JSON parsing."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomlog.functions.extract import cleaned


def compacted_runs(documents: DataFrame, keep: int) -> DataFrame:
    """doc_id, dropped, sha256 of documents of which runs of equal lines are cut to keep lines."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    order = W.partitionBy("doc_id").orderBy("pos")
    fresh = F.coalesce(F.lag("line").over(order) != F.col("line"), F.lit(True))
    rows = lines.withColumn("fresh", fresh)
    rows = rows.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "island").orderBy("pos")))
    kept = F.array_sort(F.collect_list(F.when(F.col("k") <= keep, F.struct("pos", "line"))))
    out = rows.groupBy("doc_id").agg(F.count_if(F.col("k") > keep).alias("dropped"), kept.alias("kept"))
    return out.where("dropped > 0").select("doc_id", "dropped", F.sha2(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), 256).alias("sha256"))


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}|(.?))', re.S)


def repair_escapes(text: str) -> tuple[str, int]:
    """Doubles the backslashes inside strings that begin no valid escape; and how many."""
    count = 0

    def fix(m: re.Match) -> str:
        nonlocal count
        if m.group(1) is None:
            return m.group()
        count += 1
        return "\\\\" + m.group(1)

    return _STRING.sub(lambda s: _ESCAPE.sub(fix, s.group()), text), count


@dataclass
class Parsed:
    """status: exact, repaired_escapes, repaired_controls, not_object, blank or error; value: the object, if there is one."""

    status: str
    value: dict | None = None
    repairs: int = 0
    error: str | None = None


def parse_object(text: str | None) -> Parsed:
    """A JSON object, tolerantly: as it is, else with escapes repaired, else (nothing to repair) with control characters allowed."""
    if text is None or not text.strip():
        return Parsed("blank")
    try:
        value = json.loads(text)
        return Parsed("exact", value) if isinstance(value, dict) else Parsed("not_object", error="not an object")
    except (ValueError, RecursionError) as e:
        first = str(e)
    fixed, n = repair_escapes(text)
    try:
        value = json.loads(fixed, strict=n > 0)
    except (ValueError, RecursionError):
        return Parsed("error", error=first)
    if not isinstance(value, dict):
        return Parsed("not_object", error="not an object")
    return Parsed("repaired_escapes" if n else "repaired_controls", value, max(1, n), first)


def tolerant_parse(text: str | None) -> tuple[str, int]:
    """(status, repairs) of a line."""
    p = parse_object(text)
    return p.status, p.repairs


def is_complete(raw: bytes) -> bool:
    """Whether the end of a growing log is a whole record: valid UTF-8 and blank, JSON or repairable."""
    try:
        return parse_object(raw.decode("utf-8")).status != "error"
    except UnicodeDecodeError:
        return False


def parse_status(rows: DataFrame) -> DataFrame:
    """record_id, status, repairs, error, sha256 and preview (of lines that are not exact) of each JSON line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("raw_json").to_pylist()
            out = [(p.status, p.repairs, p.error) for p in map(parse_object, given)]
            odd = [t if x[0] not in ("exact", "blank") else None for t, x in zip(given, out)]
            audit = [[None if t is None else f(t) for t in odd] for f in (lambda t: hashlib.sha256(t.encode()).hexdigest(), lambda t: t[:240])]
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), *columns, *(pa.array(a, pa.string()) for a in audit)], names=["record_id", "status", "repairs", "error", "sha256", "preview"])

    own = dict(rows.dtypes)["record_id"]
    return rows.select("record_id", "raw_json").mapInArrow(run, f"record_id {own}, status string, repairs int, error string, sha256 string, preview string")


# ------------------------------------------------------------------------------------------------ all texts


def log_texts(lines: DataFrame, items: DataFrame) -> DataFrame:
    """table_name, record_id, field, text: every text of both logs, one row each; null ones are left out."""
    one = lambda df, table, key, field, text: df.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.lit(field).alias("field"), text.alias("text"))
    rollout = lambda field, text: one(lines, "rollout_lines", "line_id", field, text)
    history = lines.select("line_id", F.explode("payload.replacement_history").alias("h")).select("line_id", F.explode("h.content").alias("p"))
    changes = lines.select("line_id", F.explode(F.map_values("payload.item.changes")).alias("c"))
    out = rollout("message", F.col("payload.message"))
    out = out.unionByName(rollout("arguments", F.col("payload.item.arguments"))).unionByName(rollout("output", F.col("payload.item.output")))
    out = out.unionByName(rollout("item_content", F.explode("payload.item.content.text")))
    out = out.unionByName(one(history, "rollout_lines", "line_id", "history", F.col("p.text"))).unionByName(one(changes, "rollout_lines", "line_id", "change", F.col("c.content")))
    return out.unionByName(one(items, "response_items", "item_id", "content", F.explode("payload.content.text"))).where("text is not null")


def cleaning_counts(texts: DataFrame) -> DataFrame:
    """table_name, step, n: how often each cleaning step applied, summed inside each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for table, text in zip(b.column("table_name").to_pylist(), b.column("text").to_pylist()):
                cleaned(text, seen.setdefault(table, Counter()))
            rows = [(t, k, n) for t, c in seen.items() for k, n in c.items() if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["table_name", "step", "n"])

    return texts.select("table_name", "text").mapInArrow(run, "table_name string, step string, n bigint").groupBy("table_name", "step").agg(F.sum("n").alias("n"))


def mapped(rows: DataFrame, key: str, text: str, outputs: dict[str, str], apply) -> DataFrame:
    """key and outputs (name to type) of a plain function of one text that gives a tuple; for what no expression can say."""
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [apply(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], types[t]) for k, t in enumerate(outputs.values()))], names=[key, *outputs])

    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in outputs.items()))
