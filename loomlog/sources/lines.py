"""Log lines with their byte ranges, from plain or zstd-compressed files.

A data source that yields (path, line_no, byte_start, byte_end, raw): binary lines ended by a line feed, offsets in the
decompressed bytes.  Plain files are read in splits of ``splitBytes``, compressed ones whole; one line at a time is held.
Option ``maxLines`` stops after the first lines of each file.  Paths must be readable on the executors (a shared mount).
"""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one task reads, and what opening a file counts for.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
SPLIT_SCHEMA = "path string, split int, line_no bigint, byte_start bigint, byte_end bigint, raw binary"
SCHEMA = "path string, line_no bigint, byte_start bigint, byte_end bigint, raw binary"


def files(path: str) -> list[str]:
    """Log files at a path: a file, a pattern, or all below a folder."""
    if os.path.isdir(path):
        found = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith((".jsonl", ".jsonl.zst"))]
    else:
        found = glob.glob(path)
    return sorted(found)


class _Frames(io.RawIOBase):
    """Decompressed bytes of all frames of a stream, one after another; an incomplete frame raises, wherever it ends."""

    def __init__(self, raw, path: str):
        import zstandard

        self.raw, self.path, self.frame = raw, path, zstandard.ZstdDecompressor()
        self.open, self.left, self.ready = None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            piece, self.left = self.left or self.raw.read(1 << 20), b""
            if not piece:
                if self.open is not None:
                    raise EOFError(f"incomplete zstd frame at the end of {self.path}")
                return 0
            self.open = self.open or self.frame.decompressobj()
            self.ready = self.open.decompress(piece)
            if self.open.eof:
                self.left, self.open = self.open.unused_data, None
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n

    def close(self) -> None:
        self.raw.close()
        super().close()


def open_log(path: str):
    """Binary stream of a file; all frames of a compressed one.  An incomplete last frame raises when it is reached."""
    raw = open(path, "rb")
    return io.BufferedReader(_Frames(raw, path), 1 << 20) if path.endswith(".zst") else raw


def lines_of(stream, at: int = 0, end: int | None = None, most: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """Lines of a stream that stands at byte ``at``, up to the one that begins before ``end``."""
    for number, line in enumerate(stream, 1):
        if most is not None and number > most or end is not None and at >= end:
            return
        yield number, at, at + len(line), line[:-1] if line.endswith(b"\n") else line
        at += len(line)


class _Group(InputPartition):
    """Splits (path, number, start, end) that one task reads: small files share a task."""

    def __init__(self, splits: list[tuple[str, int, int, int | None]]):
        super().__init__(splits)
        self.splits = splits


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], options.get("maxLines") or options.get("maxlines")
        self.size = int(options.get("splitBytes") or options.get("splitbytes") or SPLIT_BYTES)

    def partitions(self) -> list[_Group]:
        groups, held = [[]], 0
        for p in files(self.path):
            size = os.path.getsize(p)
            whole = p.endswith(".zst") or self.most or size <= self.size
            for split in [(p, 0, 0, None)] if whole else [(p, k, at, min(size, at + self.size)) for k, at in enumerate(range(0, size, self.size))]:
                cost = (split[3] or size) - split[2] + OPEN_BYTES
                if groups[-1] and held + cost > self.size:
                    groups.append([])
                    held = 0
                groups[-1].append(split)
                held += cost
        return [_Group(g) for g in groups if g]

    def read(self, group: _Group) -> Iterator[tuple]:
        for path, number, at, end in getattr(group, "splits", ()):
            with open_log(path) as stream:
                if at:  # a line belongs to the split that it begins in
                    stream.seek(at - 1)
                    at += len(stream.readline()) - 1
                for line in lines_of(stream, at, end, int(self.most) if self.most else None):
                    yield path, number, *line


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return SPLIT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_lines(spark: SparkSession, path: str, most: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of all log files at a path.  No file gives an empty table.

    Large plain files are read in splits.  Line numbers count within a split; the splits before one add their lines, for
    which only files with several splits are read twice."""
    found = files(path)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(LogLines)
    reader = spark.read.format("loglines").option("path", path).option("splitBytes", str(split_bytes))
    rows = (reader.option("maxLines", str(most)) if most else reader).load()
    if most or not any(os.path.getsize(p) > split_bytes for p in found if not p.endswith(".zst")):
        return rows.drop("split")
    counts = rows.groupBy("path", "split").agg(F.count("*").alias("lines"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("path", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["path", "split"]).select("path", (F.col("line_no") + F.col("before")).alias("line_no"), "byte_start", "byte_end", "raw")


#: Session ids and forms in the names of log files.
_NAME = r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*\.jsonl(?:\.zst)?$"


def discover(spark: SparkSession, home: str) -> DataFrame:
    """path, session_id, archived, compressed, bytes, modified of all log files below a home folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").load(home)
    rows = found.where(F.col("path").rlike(r"\.jsonl(\.zst)?$"))
    return rows.select(
        "path", F.nullif(F.regexp_extract("path", _NAME, 1), F.lit("")).alias("session_id"), F.contains("path", F.lit("/archived_sessions/")).alias("archived"),
        F.col("path").endswith(".zst").alias("compressed"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def best_files(found: DataFrame, key: str = "session_id") -> DataFrame:
    """Of several files of one session the plain one, else the newest; ties by path."""
    return found.groupBy(key).agg(F.max_by(F.struct(*[c for c in found.columns if c != key]), F.struct(~F.col("compressed"), "modified", "path")).alias("f")).select(key, "f.*")


def latest_file(found: DataFrame) -> DataFrame:
    """The log file that was written last."""
    return found.agg(F.max_by(F.struct(*found.columns), F.struct("modified", "path")).alias("f")).where("f is not null").select("f.*")
