"""Session catalogs kept outside tables: SQLite databases, append-only title files, titles set by tool calls, lists of sources.

Databases are read as whole files by the executors, each in memory; a row is a session, so they are small next to logs."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.functions.extract import embedded

# Catalog columns in order (a database may lack some), names of id and title columns, the longest title, the
# tool that sets titles, and how deep its calls may be nested.
COLUMNS = ["id", "cwd", "title", "archived", "rollout_path", "updated_at", "created_at", "project_id"]
ID_COLUMNS = ["id", "session_id", "thread_id", "conversation_id"]
TITLE_COLUMNS = ["title", "thread_title", "thread_name", "name"]
TITLE_CHARACTERS, TITLE_TOOL, WALK_DEPTH = 300, "set_thread_title", 10
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


def database_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the SQLite files at a path or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    con.execute("PRAGMA query_only = ON")
    return con


def _tables(con: sqlite3.Connection) -> dict[str, list[str]]:
    names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    return {n: [r[1] for r in con.execute(f'PRAGMA table_info("{n}")')] for n in names}


def _read(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                con = _opened(data)
                try:
                    rows = [(path, *(None if v is None else str(v) for v in r)) for r in rows_of(con)]
                finally:
                    con.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return files.mapInArrow(run, schema)


def _threads(con: sqlite3.Connection) -> Iterator[tuple]:
    have = _tables(con).get("threads", [])
    if "id" in have:
        picked = ", ".join(f'"{c}"' if c in have else "NULL" for c in COLUMNS)
        yield from (r for r in con.execute(f"SELECT {picked} FROM threads") if _UUID.fullmatch(str(r[0] or "")))


def read_databases(files: DataFrame) -> DataFrame:
    """Rows of the threads tables of SQLite files.  Columns that a database lacks are null; rows whose id is no UUID are left
    out; a file without the table gives none."""
    rows = _read(files, "path string, " + ", ".join(f"{c} string" for c in COLUMNS), _threads)
    return rows.withColumnRenamed("id", "session_id").withColumn("archived", F.col("archived").try_cast("int"))


def _titles(con: sqlite3.Connection) -> Iterator[tuple]:
    for n, (table, columns) in enumerate(_tables(con).items()):
        low = {c.lower(): c for c in columns}
        i, t = (next((low[c] for c in wanted if c in low), None) for wanted in (ID_COLUMNS, TITLE_COLUMNS))
        if i and t:
            yield from ((n, table, str(a), b.strip()) for a, b in con.execute(f'SELECT "{i}", "{t}" FROM "{table}"') if a is not None and isinstance(b, str) and 0 < len(b.strip()) <= TITLE_CHARACTERS)


def database_titles(files: DataFrame) -> DataFrame:
    """session_id, title out of any table with an id-like and a title-like column; the first table of the first file wins."""
    rows = _read(files, "path string, rank string, source_table string, session_id string, title string", _titles)
    return rows.groupBy("session_id").agg(F.min_by("title", F.struct("path", F.col("rank").cast("int"), "title")).alias("title"))


def latest_titles(lines: DataFrame) -> DataFrame:
    """session_id, title of an append-only title file read by read_lines; the last line of a session wins."""
    text = F.decode("raw", "utf-8")
    get = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names))
    rows = lines.select("path", "line_no", get("id", "session_id", "thread_id").alias("session_id"), get("thread_name", "thread_title", "title", "name").alias("title"))
    return rows.where("session_id is not null and title is not null").groupBy("session_id").agg(F.max_by("title", F.struct("path", "line_no")).alias("title"))


def walked(value: object, depth: int = 0) -> Iterator[object]:
    """A JSON value and all values in it, to a depth of WALK_DEPTH."""
    if depth <= WALK_DEPTH:
        yield value
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from walked(v, depth + 1)


def title_call(raw: str | None) -> str | None:
    """The title that the last title call of an event sets."""
    title = None
    try:
        event = json.loads(raw or "null")
    except (ValueError, RecursionError):
        return None
    for v in walked(event):
        if isinstance(v, dict) and v.get("name") == TITLE_TOOL:
            given = next((a for k in ("arguments", "args", "input") if (a := v.get(k)) is not None), None)
            given = embedded(given) if isinstance(given, str) else given
            if isinstance(given, dict) and isinstance(given.get("title"), str) and given["title"].strip():
                title = given["title"].strip()
    return title


def tool_titles(lines: DataFrame) -> DataFrame:
    """session_id, title of the last title call of each session; lines without the tool's name are not parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = pa.array([title_call(t) for t in b.column("raw").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("session_id"), b.column("line_no"), titles], names=["session_id", "line_no", "title"])

    called = lines.where(F.col("raw").contains(TITLE_TOOL)).select("session_id", "line_no", "raw")
    rows = called.mapInArrow(run, "session_id string, line_no bigint, title string")
    return rows.where("title is not null").groupBy("session_id").agg(F.max_by("title", "line_no").alias("title"))


def listed_sources(lines: DataFrame, column: str = "value") -> DataFrame:
    """source: ids and paths of a list, one a line; blank lines and comments are left out."""
    return lines.select(F.trim(column).alias("source")).where("source <> '' and not startswith(source, '#')")


def by_id_or_prefix(column: Column, wanted: str) -> Column:
    """How well a session answers to a wanted id: 0 exactly, 1 as a part of it; null not at all.  The best that is there counts."""
    return F.when(F.lower(column) == wanted.lower(), 0).when(F.lower(column).contains(wanted.lower()), 1)
