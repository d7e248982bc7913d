"""Files written by the executors to a shared mount: whole or not at all, never over another file by accident, read back.

A file is written beside its place and linked there, so readers see it whole and two writers cannot both succeed.  A task
that runs again finds its own file, by content, and keeps it."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What happens where another file is: it stays and the new one gets another name, is replaced, stays alone, or it is an error.
POLICIES = ("rename", "overwrite", "skip", "error")
PUBLISHED = "path string, written_path string, bytes bigint, sha256 string, outcome string"


def local_path(path: str) -> str:
    """The path of a file URI on a shared mount; other file systems raise, as Python cannot open their files."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"not on a mounted file system: {path}")
    return path[len("file:") :].replace("///", "/") if path.startswith("file:") else path


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _candidates(path: str) -> Iterator[str]:
    yield path
    stem, ending = os.path.splitext(path)
    n = 0
    while True:
        n += 1
        yield f"{stem}-{n}{ending}"


def put(path: str, data: bytes, policy: str = "error") -> tuple[str, str]:
    """(path written, outcome): written, same (this very content was there), replaced, skipped."""
    if policy not in POLICIES:
        raise ValueError(f"no collision policy: {policy}")
    digest = hashlib.sha256(data).hexdigest()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(aside, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if _sha256(aside) != digest:
            raise OSError(f"{path} cannot be read back as written")
        for place in _candidates(path):
            try:
                os.link(aside, place)
                return place, "written"
            except FileExistsError:
                if _sha256(place) == digest:
                    return place, "same"
                if policy == "overwrite":
                    os.replace(aside, place)
                    return place, "replaced"
                if policy == "skip":
                    return place, "skipped"
                if policy == "error":
                    raise FileExistsError(f"another file is at {place}") from None
        raise AssertionError
    finally:
        if os.path.exists(aside):
            os.unlink(aside)


def publish(files: DataFrame, root: str, policy: str = "error") -> DataFrame:
    """Writes each row's data (binary) at root/path; PUBLISHED of each.  Runs when the result is read."""
    base = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("data").to_pylist()):
                if os.path.isabs(path) or ".." in path.split("/"):
                    raise ValueError(f"no path below the root: {path}")
                place, outcome = put(os.path.join(base, path), data, policy)
                rows.append((path, os.path.relpath(place, base), len(data), hashlib.sha256(data).hexdigest(), outcome))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in PUBLISHED.split(", ")])

    return files.select("path", "data").mapInArrow(run, PUBLISHED)


def same_place(a: str, b: str) -> bool:
    """Whether two paths are one file, through links too; an output must not be its source."""
    a, b = local_path(a), local_path(b)
    return os.path.realpath(a) == os.path.realpath(b) or (os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b))
