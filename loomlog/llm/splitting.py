"""Splitting oversized texts at line ends under a byte limit, with overlap.

Character offsets are prefix sums of UTF-8 lengths, line ends a sorted array.  A piece ends at the last line end under
the limit (binary search); the next one steps back by the overlap to the first line start within it.  Only a line that
alone exceeds the limit is cut inside, between characters.

Defined results for odd input: null bodies, limits that are null and bodies within their limit give no pieces; a null
or negative overlap is 0 and one above half the limit is that half; a single character larger than the limit is a piece
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECES = (
    "member_id bigint, piece_no int, offset bigint, size bigint, overlap bigint, starts_at_line_boundary boolean, "
    "ends_at_line_boundary boolean, end_line_no bigint"
)


def split(body: bytes, limit: int, overlap: int = 0) -> list[tuple[int, int, int, bool, bool, int]]:
    """(offset, size, overlap, starts at a line, ends at a line, line of the last byte) of each piece; [] within the limit."""
    n = len(body)
    if n <= limit or n == 0:
        return []
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit // 2)
    data = np.frombuffer(body, np.uint8)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
    starts = np.append(0, np.flatnonzero(data == 10) + 1)  # line starts, which are line ends of the lines before
    last = lambda a, x: int(a[np.searchsorted(a, x, "right") - 1])
    first = lambda a, x: int(a[np.searchsorted(a, x, "left")])
    ends = starts if starts[-1] == n else np.append(starts, n)
    out, end = [], 0
    while end < n:
        line_end = first(ends, end + 1)
        at = end
        if end and overlap:
            lowest = end - overlap
            if line_end - end <= limit:
                lowest = max(lowest, line_end - limit)
            k = np.searchsorted(starts, lowest, "left")
            at = int(starts[k]) if k < len(starts) and starts[k] < end else min(first(chars, lowest), end)
        if n - at <= limit:
            stop = n
        elif (stop := last(ends, at + limit)) <= end:
            stop = last(chars, at + limit)
            if stop <= end:
                at, stop = end, max(last(chars, end + limit), first(chars, end + 1))
        line = int(np.searchsorted(starts, stop - 1, "right"))
        out.append((at, stop - at, end - at, bool(starts[np.searchsorted(starts, at, "right") - 1] == at), bool(ends[np.searchsorted(ends, stop, "right") - 1] == stop), line))
        end = stop
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, body, most, over in zip(*(b.column(c).to_pylist() for c in ("member_id", "body", "max_bytes", "overlap_bytes"))):
            rows += [(i, k, *p) for k, p in enumerate(split(body, most, over or 0))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        names = ["member_id", "piece_no", "offset", "size", "overlap", "starts_at_line_boundary", "ends_at_line_boundary", "end_line_no"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def pieces(members: DataFrame) -> DataFrame:
    """Pieces of every body above its limit, in order.  Bodies within their limit never leave the JVM; no shuffle."""
    large = members.where("octet_length(body) > max_bytes")
    return large.selectExpr("member_id", "cast(body as binary) as body", "max_bytes", "overlap_bytes").mapInArrow(_batches, PIECES)


def forced_lines(members: DataFrame) -> DataFrame:
    """Lines that a piece ends inside of."""
    cuts = pieces(members).where("not ends_at_line_boundary")
    return cuts.selectExpr("member_id", "end_line_no as line_no").distinct()
