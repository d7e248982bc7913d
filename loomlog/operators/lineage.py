"""Byte-exact excerpts: ranges of native lines, the context they need, and where each came from.

A range is (session_id, line_start, line_end, byte_start, byte_end, kind): lines counted from 1 and inclusive, bytes from 0 and
half-open, kind selected or context.  Ranges, lines and contexts meet by running aggregates on skew-safe blocks; nothing is
collected by session.  Hashes are taken as the lines of a range stream by.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlog.operators.folds import ordered_sha256
from loomlog.operators.running import running
from loomlog.storage import materialize

RANGE = ["session_id", "line_start", "line_end", "byte_start", "byte_end", "kind"]
#: Bytes of a session whose ranges are ordered together.
BLOCK = 1 << 22


def native_lines(events: DataFrame) -> DataFrame:
    """session_id, line_no, byte_start, byte_end, raw, meta, context of typed events; a line is its message and a line feed.

    Logs read by sources.lines have their bytes and ranges already."""
    raw = F.encode(F.concat(F.coalesce("payload.message", F.lit("")), F.lit("\n")), "utf-8")
    rows = events.select("session_id", "line_no", raw.alias("raw"), (F.col("type") == "session_meta").alias("meta"), (F.col("type") == "turn_context").alias("context"))
    rows = materialize(rows.withColumn("size", F.octet_length("raw").cast("bigint")), "native")
    rows = running(rows, ["session_id"], "line_no", {"byte_end": ("sum", F.col("size"))})
    return materialize(rows.select("session_id", "line_no", (F.col("byte_end") - F.col("size")).alias("byte_start"), "byte_end", "raw", "meta", "context"), "native")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def turn_ranges(lines: DataFrame, turns: DataFrame, first: int, last: int) -> DataFrame:
    """The lines of turns first to last of each session that has the first one: up to the next turn or the end."""
    ends = lines.groupBy(F.col("session_id").alias("e")).agg(F.max("line_no").alias("line_last"), F.max("byte_end").alias("byte_last"))
    picked = turns.where(F.col("turn_no").isin(first, last + 1)).groupBy("session_id").agg(
        F.max(F.when(F.col("turn_no") == first, F.col("line_no"))).alias("line_start"), F.max(F.when(F.col("turn_no") == last + 1, F.col("line_no"))).alias("line_next")
    )
    at = lambda name: lines.select(F.col("session_id").alias(f"{name}_s"), F.col("line_no").alias(f"{name}_n"), F.col("byte_start").alias(f"{name}_byte"))
    rows = picked.where("line_start is not null").join(ends, _same("session_id", "e"))
    rows = rows.join(at("a"), _same("session_id", "a_s") & (F.col("line_start") == F.col("a_n"))).join(at("b"), _same("session_id", "b_s") & (F.col("line_next") == F.col("b_n")), "left")
    return rows.select(
        "session_id", "line_start", F.coalesce(F.col("line_next") - 1, "line_last").alias("line_end"), F.col("a_byte").alias("byte_start"), F.coalesce("b_byte", "byte_last").alias("byte_end"), F.lit("selected").alias("kind")
    )


def line_ranges(lines: DataFrame, records: DataFrame) -> DataFrame:
    """One range for each line behind the records (source_lines), each once.

    A negative line stands for a record that was rebuilt and has no native bytes; it raises, as does a line that the log lacks."""
    wanted = records.select("session_id", F.explode("source_lines").alias("n")).distinct()
    known = lines.select(F.col("session_id").alias("s"), "line_no", "byte_start", "byte_end")
    rows = wanted.join(known, _same("session_id", "s") & (F.col("n") == F.col("line_no")), "left")
    bad = F.when(F.col("n") <= 0, "a rebuilt record has no native line").when(F.col("line_no").isNull(), "a selected line does not exist")
    rows = rows.withColumn("line_no", F.when(bad.isNotNull(), F.raise_error(bad).cast("bigint")).otherwise(F.col("line_no")))
    return rows.select("session_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "byte_start", "byte_end", F.lit("selected").alias("kind"))


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges in order without covered ones, adjacent ones of a kind joined.  Partly overlapping ranges raise."""
    size = {"before": ("max", F.struct("byte_end", "line_end"))}
    rows = running(materialize(ranges.select(RANGE).distinct(), "ranges"), ["session_id"], "byte_start", size, before_only=True, block=BLOCK)
    reach = F.col("before.byte_end")
    rows = rows.where(reach.isNull() | (F.col("byte_end") > reach))
    clash = F.raise_error(F.lit("ranges overlap")).cast("bigint")
    rows = materialize(rows.withColumn("byte_start", F.when(F.col("byte_start") < reach, clash).otherwise(F.col("byte_start"))).drop("before"), "ranges")
    rows = running(rows, ["session_id"], "byte_start", {"before": ("max", F.struct("byte_start", "byte_end", "line_end", "kind"))}, before_only=True, block=BLOCK)
    joins = (F.col("before.kind") == F.col("kind")) & (F.col("before.byte_end") == F.col("byte_start")) & (F.col("before.line_end") + 1 == F.col("line_start"))
    rows = materialize(rows.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1).cast("bigint")).drop("before"), "ranges")
    rows = running(rows, ["session_id"], "byte_start", {"island": ("sum", F.col("fresh"))}, block=BLOCK)
    out = rows.groupBy("session_id", "island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.first("kind").alias("kind"))
    return out.select(RANGE)


def _covering(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with the range (line_start, line_end) that begins last at or before them; they are in it up to its end."""
    starts = ranges.select(F.col("session_id").alias("s"), F.col("line_start").alias("n"), F.struct("line_start", "line_end").alias("begun"))
    rows = lines.join(starts, _same("session_id", "s") & (F.col("line_no") == F.col("n")), "left").drop("s", "n")
    return running(materialize(rows, "covering"), ["session_id"], "line_no", {"range": ("max", F.col("begun"))}).drop("begun")


def with_context(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Ranges with the session's first metadata line, if it lies before them, and for each range the last turn context
    before it, if no range holds it; merged."""
    ranges = materialize(merged(ranges), "ranges")
    narrow = lines.select("session_id", "line_no", "byte_start", "byte_end", "meta", "context")
    place = F.struct("line_no", "byte_start", "byte_end")
    seen = running(narrow, ["session_id"], "line_no", {"last": ("max", F.when(F.col("context"), place))}, before_only=True)
    starts = ranges.select(F.col("session_id").alias("s"), F.col("line_start").alias("n"))
    needed = seen.join(starts, _same("session_id", "s") & (F.col("line_no") == F.col("n"))).where("last is not null").select("session_id", "last.*").distinct()
    inside = _covering(needed.unionByName(ranges.select("session_id", F.col("line_start").alias("line_no"), "byte_start", "byte_end")).distinct(), ranges)
    free = inside.where(F.col("range").isNull() | (F.col("line_no") > F.col("range.line_end")))
    first = ranges.groupBy(F.col("session_id").alias("s")).agg(F.min("line_start").alias("n"))
    meta = narrow.where("meta").groupBy("session_id").agg(F.min(place).alias("m")).join(first, _same("session_id", "s")).where("m.line_no < n").select("session_id", "m.*")
    extra = free.select("session_id", "line_no", "byte_start", "byte_end").unionByName(meta).distinct()
    as_range = extra.select("session_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "byte_start", "byte_end", F.lit("context").alias("kind"))
    return merged(ranges.unionByName(as_range))


def provenance(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Ranges with their place in the excerpt (lines from 1, bytes from 0) and the hash of their bytes."""
    ranges = ranges.withColumn("lines", F.col("line_end") - F.col("line_start") + 1).withColumn("bytes", F.col("byte_end") - F.col("byte_start"))
    placed = running(materialize(ranges, "placed"), ["session_id"], "byte_start", {"line_to": ("sum", F.col("lines")), "byte_to": ("sum", F.col("bytes"))}, block=BLOCK)
    held = _covering(lines.select("session_id", "line_no", "raw"), ranges).where(F.col("line_no") <= F.col("range.line_end"))
    sha = ordered_sha256(held.select(F.col("session_id").alias("s"), F.col("range.line_start").alias("n"), "line_no", "raw"), {"s": pa.string(), "n": pa.int64()}, ["line_no"], "raw")
    return placed.join(sha, _same("session_id", "s") & (F.col("line_start") == F.col("n"))).select(
        *RANGE, (F.col("line_to") - F.col("lines") + 1).alias("excerpt_line_start"), F.col("line_to").alias("excerpt_line_end"),
        (F.col("byte_to") - F.col("bytes")).alias("excerpt_byte_start"), F.col("byte_to").alias("excerpt_byte_end"), "sha256",
    )
