"""Markdown documents written as their sections stream by: one file for each session, no session held in memory."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import text as X
from loomlog.operators.folds import fold_sorted
from loomlog.sinks.files import local_path

WRITTEN = "session_id string, path string, sections bigint, bytes bigint, sha256 string"


def front_matter(values: dict[str, Column]) -> Column:
    """YAML front matter of plain values."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in values.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def section() -> Column:
    """A record (role, timestamp, text) as a section; actions and notes keep their own headings."""
    head = F.when(F.col("role") == "user", "## User").when(F.col("role") == "assistant", "## Assistant").when(F.col("role") == "tool", "## Tool").otherwise("## Note")
    when = F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit("*"), "timestamp", F.lit("*\n\n"))).otherwise("")
    return F.concat(head, F.lit("\n\n"), when, "text", F.lit("\n\n"))


def sections(records: DataFrame, summary: DataFrame) -> DataFrame:
    """session_id, place, data: a head out of the session's summary (prompts, replies, actions), then its records in order."""
    named = {"session": X.yaml_quoted("session_id"), **{c: F.col(c).cast("string") for c in ("prompts", "replies", "actions")}}
    heads = summary.select("session_id", F.lit(-1).cast("bigint").alias("place"), F.encode(front_matter(named), "utf-8").alias("data"))
    return heads.unionByName(records.select("session_id", F.col("line_no").alias("place"), F.encode(section(), "utf-8").alias("data")))


class _Document:
    """A file that grows; it gets its name when it is whole, and then replaces an earlier one of the same session."""

    def __init__(self, session: str | None, base: str):
        self.session, self.path = session, os.path.join(base, f"{session or 'none'}.md")
        os.makedirs(base, exist_ok=True)
        self.aside = f"{self.path}.{os.getpid()}.part"
        self.file, self.sha, self.sections, self.bytes = open(self.aside, "wb"), hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> list:
        self.file.write(data)
        self.sha.update(data)
        self.sections += 1
        self.bytes += len(data)
        return []

    def close(self) -> list[tuple]:
        self.file.close()
        os.replace(self.aside, self.path)
        return [(self.session, self.path, self.sections, self.bytes, self.sha.hexdigest())]


def write(parts: DataFrame, root: str) -> DataFrame:
    """Writes the sections of each session, in order, to a file below root; WRITTEN of each.  Runs when the result is read."""
    base = local_path(root)
    begin: Callable = lambda key: _Document(key[0], base)
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return fold_sorted(parts.select("session_id", "place", "data"), ["session_id"], ["place"], WRITTEN, types, begin, lambda d, row: d.add(row[2]), lambda d: d.close())


def with_own_counts(template: Callable[[int, int], str], count: Callable[[str], tuple[int, int]], rounds: int = 12) -> str:
    """A document that states its own lines and tokens: rendered again until the numbers it states are those it has."""
    lines, tokens = 0, 0
    for _ in range(rounds):
        text = template(lines, tokens)
        if (found := count(text)) == (lines, tokens):
            return text
        lines, tokens = found
    return text
