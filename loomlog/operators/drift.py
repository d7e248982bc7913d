"""Rescue-column ingestion of records whose schema drifts between files.

One pass holds every record against a target schema.  Fields that fit become typed values; fields of other types at a
target path (uncast) and all unknown fields stay as JSON under their path in a rescue column.  The same pass tallies, for
each file, what the ingestion did with which field: typed, uncast or rescued, with which type and value shapes.  The
change report compares a file's tallies with those of the file before it in its stream: renamed, retyped, added, removed.
Renames and approved added fields are promoted, and the rescued values replayed into typed columns without parsing again.

Defined results for odd input: a line that is null or no JSON object gives a row whose rescue column holds the raw
text under ``_corrupt``; null values count as absent; a field with several types in a file has its most frequent one
(ties: alphabetically first); the first file of a stream has no changes; files without a number have none either.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomlog.operators.running import running
from loomlog.storage import materialize

#: Target schema: path to type.
TARGET = {
    "session_id": "string",
    "timestamp": "string",
    "type": "string",
    "client_version": "string",
    "payload.type": "string",
    "payload.role": "string",
    "payload.id": "string",
    "payload.status": "string",
    "payload.content": "array",
    "usage.total_tokens": "number",
}
#: Added fields of the change report that were approved for promotion.
APPROVED = {
    "locale": "string",
    "retry_count": "number",
    "payload.flags": "array",
    "payload.phase": "string",
    "payload.pinned": "boolean",
    "payload.turn_id": "string",
    "usage.cached_tokens": "number",
}
#: A removed and an added field of one type are one renamed field if their value profiles agree to this share.
SAME_VALUES = 0.5
#: Value shapes are counted in so many hash buckets, so that a field with many distinct values makes no large group.
BUCKETS = 4096

_RUN = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]{1,24}([_ -][^\W\d_]{1,24}){0,2}")
_KINDS = {bool: "boolean", int: "number", float: "number", str: "string", dict: "object", list: "array"}


def promote(target: dict[str, str], approved: dict[str, str]) -> dict[str, str]:
    """The target schema with approved fields; a field that has another type already raises."""
    for path, kind in approved.items():
        if target.get(path, kind) != kind or kind not in ("string", "number", "boolean", "array"):
            raise ValueError(f"{path} cannot be promoted as {kind}")
    return target | approved


def value_shape(v: object) -> str:
    """What values of one field have in common: short words themselves, the magnitude of numbers, the punctuation of ids."""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{'f' if isinstance(v, float) else 'i'}{len(str(abs(int(v)))) if abs(v) < 1e18 else 19}"
    if not isinstance(v, str):
        return ""
    if len(v) > 96 or v.count(" ") > 2:
        return f"text{len(v).bit_length() // 2}"
    return v.lower() if _WORD.fullmatch(v) else _RUN.sub("w", v)


@lru_cache(maxsize=1 << 16)
def _short_bucket(v: str) -> int:
    return crc32(value_shape(v).encode("utf-8", "replace")) % BUCKETS


def bucket(v: object) -> int:
    if type(v) is str and len(v) <= 96:
        return _short_bucket(v)
    return crc32(value_shape(v).encode("utf-8", "replace")) % BUCKETS


def fields(node: object, path: str = "") -> Iterator[tuple[str, object]]:
    """Paths and values other than null; ``[]`` after arrays of objects, whose scalars do not count."""
    if isinstance(node, dict):
        for k, v in node.items():
            if v is not None:
                p = f"{path}.{k}" if path else k
                yield p, v
                if type(v) is dict or type(v) is list:
                    yield from fields(v, p)
    elif isinstance(node, list):
        for v in node:
            if isinstance(v, dict):
                yield from fields(v, f"{path}[]")


def _load(raw: str | None) -> dict | None:
    try:
        v = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


# ------------------------------------------------------------------------------------------------ ingestion

_ROW = "record_id bigint, stream string, file_no int, file_name string, line_no int, typed map<string,string>, rescued map<string,string>"
_TALLY = "path string, outcome string, kind string, bucket int, n bigint"
INGESTED = f"{_ROW}, {_TALLY}"


def ingest_record(raw: str | None, target: dict[str, str], rows: bool = True) -> tuple[dict[str, str], dict[str, str], set[tuple]]:
    """(typed values, rescued JSON by leaf path, facts) of one record; facts are (path, outcome, kind, bucket)."""
    typed, rescued, facts = {}, {}, set()
    if (record := _load(raw)) is None:
        return {}, {"_corrupt": raw} if rows else {}, facts
    facts.add(("", "record", "object", 0))
    for p, v in fields(record):
        kind = _KINDS[type(v)]
        want = target.get(p)
        facts.add((p, "typed" if want == kind else "uncast" if want else "rescued", kind, bucket(v)))
        if not rows:
            continue
        if want == kind:
            typed[p] = v if kind == "string" else json.dumps(v, ensure_ascii=False)
        elif "[]" not in p and (kind != "object" or not any(x is not None for x in v.values())):
            rescued[p] = json.dumps(v, ensure_ascii=False)  # objects are rescued field by field
    return typed, rescued, facts


def _ingest(batches: Iterator[pa.RecordBatch], target: dict[str, str], rows: bool) -> Iterator[pa.RecordBatch]:
    text = pa.map_(pa.string(), pa.string())
    for b in batches:
        typed, rescued, seen = [], [], Counter()
        for s, no, name, raw in zip(*(b.column(c).to_pylist() for c in ("stream", "file_no", "file_name", "raw_json"))):
            t, r, facts = ingest_record(raw, target, rows)
            if rows:
                typed.append(list(t.items()))
                rescued.append(list(r.items()))
            seen.update((s, no, name, *f) for f in facts)
        if rows:
            own = [b.column(c) for c in ("record_id", "stream", "file_no", "file_name", "line_no")] + [pa.array(typed, text), pa.array(rescued, text)]
            none = [pa.nulls(b.num_rows, t) for t in (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *none], names=_NAMES)
        k = list(zip(*seen)) or [()] * 7
        n = len(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(k[0], pa.string()), pa.array(k[1], pa.int32()), pa.array(k[2], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, text), pa.nulls(n, text)]
            + [pa.array(k[i], pa.string()) for i in (3, 4, 5)] + [pa.array(k[6], pa.int32()), pa.array(list(seen.values()), pa.int64())],
            names=_NAMES,
        )


_NAMES = [c.split()[0] for c in ("record_id stream file_no file_name line_no typed rescued path outcome kind bucket n".split())]


def ingest(records: DataFrame, target: dict[str, str] = TARGET, rows: bool = True) -> DataFrame:
    """One pass over the raw lines, without a shuffle: a row for each record (path null) and tally rows (path not null).

    Tallies are counted inside each batch.  Without rows only they are given: what is enough for the report."""
    return records.select("record_id", "stream", "file_no", "file_name", "line_no", "raw_json").mapInArrow(partial(_ingest, target=target, rows=rows), INGESTED)


def outcomes(ingested: DataFrame) -> DataFrame:
    """file_name, field_path, outcome, n: records of each file in which a field was typed, uncast or rescued with some value shape."""
    return ingested.where("path <> ''").groupBy("file_name", F.col("path").alias("field_path"), "outcome").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------------------------ change report


def _parents(path: str) -> Iterator[str]:
    """Paths above a path, nearest first, with and without their ``[]``."""
    at = path.rfind(".")
    while at > 0:
        path = path[:at]
        yield path[:-2] if path.endswith("[]") else path
        at = path.rfind(".")


def _profiles(paths: list, kinds_: list, buckets: list, counts: list) -> tuple[dict[str, str], dict[str, float], dict[str, Counter]]:
    """Kind, share of records and value profile of each field of one file."""
    total, votes, shapes = 1, {}, {}
    for p, k, s, n in zip(paths, kinds_, buckets, counts):
        if p:
            votes.setdefault(p, Counter())[k] += n
            shapes.setdefault((p, k), Counter())[s] += n
        else:
            total = max(1, n)
    kinds = {p: min(v, key=lambda k: (-v[k], k)) for p, v in votes.items()}
    share = {p: min(1.0, sum(v.values()) / total) for p, v in votes.items()}
    values = {p: shapes[p, k] for p, k in kinds.items()}
    nested = {p: Counter(values[p]) for p, k in kinds.items() if k in ("object", "array")}
    for p, k in kinds.items():  # what lies below counts to the profile of objects and arrays
        for parent in _parents(p):
            if parent in nested:
                below = p[len(parent) :]
                for s, n in values[p].items() if k not in ("object", "array") else [("", 1)]:
                    nested[parent][below, s] += n
    return kinds, share, values | nested


def _likeness(a: Counter, b: Counter) -> float:
    x, y = sum(a.values()) or 1, sum(b.values()) or 1
    return sum(min(n / x, b[s] / y) for s, n in a.items() if s in b)


def _below(path: str, others: set[str]) -> bool:
    return any(o in others for o in _parents(path))


def compare(before: tuple, after: tuple) -> list[tuple[str, str, str, str | None]]:
    """(change, field_path, new_path, detail) between the tallies (paths, kinds, buckets, counts) of two files."""
    k0, s0, v0 = _profiles(*before)
    k1, s1, v1 = _profiles(*after)
    retyped = {p for p in k0.keys() & k1.keys() if k0[p] != k1[p]}
    gone, new = k0.keys() - k1.keys(), k1.keys() - k0.keys()
    gone = {p for p in gone if not _below(p, gone | retyped)}
    new = {p for p in new if not _below(p, new | retyped)}
    pairs = sorted(
        ((_likeness(v0[a], v1[b]) * (min(s0[a], s1[b]) / max(s0[a], s1[b])) ** 0.5, a, b) for a in gone for b in new if k0[a] == k1[b]),
        key=lambda x: (-x[0], x[1], x[2]),
    )
    out: list[tuple[str, str, str, str | None]] = []
    for score, a, b in pairs:
        if score >= SAME_VALUES and a in gone and b in new:
            out.append(("renamed", a, b, None))
            gone.remove(a)
            new.remove(b)
    retyped = {p for p in retyped if not _below(p, retyped)}
    out += [("retyped", p, "", f"{k0[p]} to {k1[p]}") for p in sorted(retyped)]
    out += [("removed", p, "", k0[p]) for p in sorted(gone)] + [("added", p, "", k1[p]) for p in sorted(new)]
    return out


CHANGES = "stream string, file_no int, file_name string, change string, field_path string, new_path string, detail string"
_TALLIED = ("path", "kind", "bucket", "n")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, before = (list(zip(*(b.column(f"{side}_{c}").to_pylist() for c in _TALLIED))) for side in ("own", "before"))
        out = []
        for stream, no, name, after, earlier in zip(*(b.column(c).to_pylist() for c in ("stream", "file_no", "file_name")), own, before):
            out += [(stream, no, name, *r) for r in compare(earlier, after)]
        types = [pa.string(), pa.int32(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in CHANGES.split(", ")])


def report(ingested: DataFrame) -> DataFrame:
    """The change report of what ingest tallied.

    Tallies are summed by file, field, type and bucket; a row then holds one file's, schema-sized whatever the number of
    its records, and is joined to that of the file before it in its stream."""
    tallies = ingested.where("path is not null and file_no is not null")
    counts = tallies.groupBy("stream", "file_no", "path", "kind", "bucket").agg(F.sum("n").alias("n"), F.min("file_name").alias("file_name"))
    files = counts.groupBy("stream", "file_no").agg(F.min("file_name").alias("file_name"), F.collect_list(F.struct(*_TALLIED)).alias("t"))
    files = materialize(files.select("stream", "file_no", "file_name", *(F.col(f"t.{c}").alias(f"own_{c}") for c in _TALLIED)), "tallies")
    order = running(files.select("stream", "file_no"), ["stream"], "file_no", {"before_no": ("max", F.col("file_no"))}, before_only=True)
    earlier = files.select(F.col("stream").alias("s"), F.col("file_no").alias("before_no"), *(F.col(f"own_{c}").alias(f"before_{c}") for c in _TALLIED))
    pairs = files.join(order.where("before_no is not null").toDF("s1", "n1", "before_no"), F.col("stream").eqNullSafe(F.col("s1")) & (F.col("file_no") == F.col("n1")))
    pairs = pairs.drop("s1", "n1").join(earlier, F.col("stream").eqNullSafe(F.col("s")) & (pairs["before_no"] == earlier["before_no"]))
    return pairs.select("stream", "file_no", "file_name", *(f"{side}_{c}" for side in ("own", "before") for c in _TALLIED)).mapInArrow(_compare, CHANGES)


def changes(records: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """The change report of raw records, out of their ingestion."""
    return report(ingest(records, target, rows=False))


# ------------------------------------------------------------------------------------------------ promotion and replay


def follow(renames: list[tuple[str, str]], now: dict[str, str]) -> dict[str, str]:
    """Present names of fields by their first names, after one file's renames (old path, new path).

    A field below a renamed object goes with it."""
    back = {v: k for k, v in now.items()}
    moved = {}
    for old, new in renames:
        under = next((q for q in _parents(old) if q in back), None)
        first = back.get(old) or (back[under] + old[len(under) :] if under else old)
        moved[first] = new
        moved |= {k: new + v[len(old) :] for k, v in now.items() if v.startswith(old + ".")}
    return {k: v for k, v in {**now, **moved}.items() if k != v}


def present_name(path: str, now: dict[str, str]) -> str:
    """The name that a field has now: its own new name, or its old one below a renamed object."""
    if path in now:
        return now[path]
    under = next((q for q in _parents(path) if q in now), None)
    return now[under] + path[len(under) :] if under else path


def _names(pdf: pd.DataFrame, paths: list[str]) -> pd.DataFrame:
    rows, now = [], {}
    for no, group in pdf.sort_values("file_no").groupby("file_no"):
        now = follow(list(zip(group["field_path"], group["new_path"])), now)
        rows.append((pdf["stream"].iloc[0], int(no), [present_name(p, now) for p in paths]))
    return pd.DataFrame(rows, columns=["stream", "file_no", "names"])


def names(changes: DataFrame, files: DataFrame, target: dict[str, str]) -> DataFrame:
    """stream, file_no, names: what each target field is called in each file, in the order of target.

    Only the renames of a stream are folded in order: a few rows for each change of its schema."""
    renamed = changes.where("change = 'renamed'").select("stream", "file_no", "field_path", "new_path")
    paths = list(target)
    known = renamed.groupBy("stream").applyInPandas(lambda pdf: _names(pdf, paths), "stream string, file_no int, names array<string>")
    known = known.select("stream", "file_no", F.struct("file_no", "names").alias("given"))
    every = files.select("stream", "file_no").where("file_no is not null").distinct().join(known, ["stream", "file_no"], "left")
    filled = running(every, ["stream"], "file_no", {"last": ("max", F.col("given"))})
    return filled.select("stream", "file_no", F.col("last.names").alias("names"))


def _key(path: str, at: int) -> Column:
    """Where a field's value is rescued: under its name in this file, under its own, or as the only field of an object there."""
    name = F.coalesce(F.get("names", F.lit(at)), F.lit(path))
    inside = lambda n: F.filter(F.map_keys("rescued"), lambda k: k.startswith(F.concat(n, F.lit("."))))
    only = lambda n: F.when(F.size(inside(n)) == 1, F.get(inside(n), F.lit(0)))
    has = lambda n: F.when(F.map_contains_key("rescued", n), n)
    return F.coalesce(has(name), only(name), has(F.lit(path)), only(F.lit(path)))


def _replayed(path: str, kind: str, at: int) -> Column:
    """The value of a target field: the typed one, else the rescued one, cast."""
    raw, typed = F.col("rescued")[_key(path, at)], F.col("typed")[path]
    if kind == "array":  # a scalar that took the place of the list is its only element
        return F.coalesce(typed, F.when(raw.startswith("["), raw).when(raw.isNotNull() & ~raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))))
    listed = F.from_json(raw, "array<string>")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    value = F.when(raw.startswith("["), F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))).when(~raw.startswith("{"), plain)
    value = F.coalesce(typed, value)
    return value.try_cast("double") if kind == "number" else value.try_cast("boolean") if kind == "boolean" else value


def replay(rows: DataFrame, file_names: DataFrame, target: dict[str, str]) -> DataFrame:
    """Ingested rows as one table: target columns with rescued values cast into them, and what is still rescued as JSON.

    file_names has a row for each file, far fewer than records; Spark broadcasts it only below its own size threshold."""
    own = ["record_id", "stream", "file_no", "file_name", "line_no"]
    given = file_names.toDF("_s", "_n", "names")
    rows = rows.join(given, F.col("stream").eqNullSafe(F.col("_s")) & (F.col("file_no") == F.col("_n")), "left")
    column = {p: p.replace(".", "_") for p in target}
    rows = rows.select(*own, "typed", "rescued", "names", *(_replayed(p, k, i).alias(column[p]) for i, (p, k) in enumerate(target.items())))
    # what was not typed and could not be cast either stays rescued
    used = F.array_compact(F.array(*(F.when(F.col("typed")[p].isNull() & F.col(column[p]).isNotNull(), _key(p, i)) for i, p in enumerate(target))))
    left = F.map_filter("rescued", lambda k, v: ~F.array_contains(used, k))
    return rows.select(*own, *column.values(), F.when(F.size(left) > 0, F.to_json(left)).alias("rescued"))


def consistent(records: DataFrame, target: dict[str, str] = TARGET, approved: dict[str, str] = APPROVED) -> DataFrame:
    """One table of all files: each record parsed once, renames and approved fields promoted, rescued values replayed."""
    ingested = materialize(ingest(records, target), "ingested")
    wider = promote(target, approved)
    rows = ingested.where("path is null")
    return replay(rows, names(report(ingested), rows, wider), wider)
