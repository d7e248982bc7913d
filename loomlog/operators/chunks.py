"""Lossless cutting of texts into parts of bounded bytes, and the proof that parts make up the original."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

PARTS = "doc_id bigint, part_no int, byte_start bigint, byte_end bigint, body binary"


def cut(data: bytes, limit: int) -> list[tuple[int, int]]:
    """Byte ranges of at most limit (4 or more): up to the last line end in the second half, else a character boundary."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + max(4, limit))
        if end < len(data):
            line = data.rfind(b"\n", at + (end - at) // 2, end) + 1
            if line:
                end = line
            else:
                while data[end] & 0xC0 == 0x80:
                    end -= 1
        out.append((at, end))
        at = end
    return out


def parts(documents: DataFrame, limit: int) -> DataFrame:
    """Parts of every document; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = (t or "").encode()
                rows += [(i, k, s, e, data[s:e]) for k, (s, e) in enumerate(cut(data, limit))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "part_no", "byte_start", "byte_end", "body"])

    return documents.select("doc_id", "text").mapInArrow(run, PARTS)


def reassembled(pieces: DataFrame) -> DataFrame:
    """doc_id, parts, bytes, sha256 of the joined parts, whole: they start at 0 and follow each other without gap or overlap."""
    order = W.partitionBy("doc_id").orderBy("byte_start", "byte_end")
    fits = F.col("byte_start") == F.coalesce(F.lag("byte_end").over(order), F.lit(0))
    rows = pieces.withColumn("fits", fits & (F.octet_length("body") == F.col("byte_end") - F.col("byte_start")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "body"))), lambda x: F.hex(x["body"]))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("parts"), F.max("byte_end").alias("bytes"), F.sha2(F.unhex(F.array_join(joined, "")), 256).alias("sha256"), F.every("fits").alias("whole")
    )


def tail(data: bytes, limit: int) -> bytes:
    """The end of a text within limit bytes, from a character's and, if one begins in its first quarter, a line's beginning."""
    out = data[-limit:] if limit < len(data) else data
    start = 0
    while start < len(out) and out[start] & 0xC0 == 0x80:
        start += 1
    line = out.find(b"\n", start)
    if len(out) < len(data) and 0 <= line < len(out) // 4:
        start = line + 1
    return out[start:]
