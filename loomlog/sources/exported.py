"""Documents of earlier exports: Markdown or text files, and ZIP files of one document with a manifest that fits it."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomlog.sinks.archives import zipped

READ = "path string, refused string, text string"


def document(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(why it is refused, text) of one file; one of both is None."""
    if not path.endswith(".zip"):
        try:
            return None, data.decode("utf-8")
        except UnicodeDecodeError:
            return "no UTF-8 text", None
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        return "unreadable", None
    infos = z.infolist()
    names = [i.filename for i in infos]
    if any(i.flag_bits & 1 for i in infos):
        return "encrypted", None
    if len(set(names)) < len(names):
        return "duplicate_name", None
    if any("/" in n or "\\" in n or n in ("", ".", "..") for n in names):
        return "unsafe_name", None
    texts, manifests = [n for n in names if n.endswith(".md")], [n for n in names if n.endswith(".manifest.json")]
    if len(texts) != 1 or len(manifests) != 1:
        return "not one document", None
    body = z.read(texts[0])
    try:
        stated = json.loads(z.read(manifests[0]))
        fits = stated["document"] == texts[0] and stated["sha256"] == hashlib.sha256(body).hexdigest()
    except (ValueError, KeyError, TypeError):
        fits = False
    return (None, body.decode("utf-8")) if fits else ("manifest does not fit", None)


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """READ of the files at a pattern; a file is read whole, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document(p, d) for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["path", "refused", "text"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, READ)


def export(name: str, text: str) -> bytes:
    """A ZIP of a document and its manifest."""
    data = text.encode()
    manifest = json.dumps({"document": f"{name}.md", "sha256": hashlib.sha256(data).hexdigest()}).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, content in ((f"{name}.md", data), (f"{name}.manifest.json", manifest)):
            z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def as_exports(members: DataFrame) -> DataFrame:
    """path, data of exports of (member_id, body), by the id modulo 6: a plain file, a sound archive, one whose manifest is of
    another text, one with two documents, one cut short, one with a path for a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, body in zip(b.column("member_id").to_pylist(), b.column("body").to_pylist()):
                whole, kind = export("document", body), i % 6
                if kind == 0:
                    rows.append((f"{i}.md", body.encode()))
                elif kind == 2:
                    with zipfile.ZipFile(io.BytesIO(export("document", body + "!"))) as z:
                        manifest = z.read("document.manifest.json")
                    rows.append((f"{i}.zip", zipped({"document.md": body.encode(), "document.manifest.json": manifest}, [])))
                elif kind == 3:
                    rows.append((f"{i}.zip", zipped({"a.md": b"a", "b.md": b"b", "a.manifest.json": b"{}"}, [])))
                elif kind == 5:
                    rows.append((f"{i}.zip", zipped({"../document.md": body.encode()}, [])))
                else:
                    rows.append((f"{i}.zip", whole if kind == 1 else whole[: len(whole) // 2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "data"])

    return members.select("member_id", "body").mapInArrow(run, "path string, data binary")
