"""ZIP archives under a size cap: pieces, packing, writing with an index, reading back and verification.

Texts above the cap are cut into pieces at line ends.  Pieces are packed by first-fit decreasing, small sets then searched
for the least number of parts.  Every part carries an index of its pieces; a set of parts is proved whole by offsets and hashes.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlog.operators.chunks import cut
from loomlog.operators.folds import ordered_sha256
from loomlog.operators.running import running
from loomlog.storage import materialize

INDEX = "INDEX.json"
#: Bytes of a member's headers, of the archive's end, and of an index entry beside its names.
MEMBER_BYTES, END_BYTES, ENTRY_BYTES = 76 + 16, 22, 200
#: Sets of up to so many pieces are searched for the least number of parts, in so many steps.
EXACT_PIECES, EXACT_STEPS = 28, 100_000
#: Bytes of members that are packed together.
SET_BYTES = 16 << 20


def first_fit_decreasing(sizes: list[int], cap: int) -> list[list[int]]:
    """Groups of positions, each of at most cap: largest first, each into the first group that takes it."""
    groups: list[list[int]] = []
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > cap:
            raise ValueError("a piece is larger than the cap")
        k = next((k for k, room in enumerate(rooms) if room >= sizes[i]), len(groups))
        if k == len(groups):
            groups.append([])
            rooms.append(cap)
        groups[k].append(i)
        rooms[k] -= sizes[i]
    return groups


def fewest_groups(sizes: list[int], cap: int) -> tuple[list[list[int]], bool]:
    """(groups, whether their number is proved least): first-fit decreasing, improved by a bounded search for small sets."""
    groups = first_fit_decreasing(sizes, cap)
    least = -(-sum(sizes) // cap)
    order, steps = sorted(range(len(sizes)), key=lambda i: -sizes[i]), 0
    if len(groups) <= max(1, least):
        return groups, True
    if len(sizes) > EXACT_PIECES:
        return groups, False
    for n in range(max(1, least), len(groups)):
        rooms, held, failed = [cap] * n, [[] for _ in range(n)], set()

        def place(k: int) -> bool | None:
            """True: all from k on are placed; False: they cannot be; None: out of steps."""
            nonlocal steps
            steps += 1
            if steps > EXACT_STEPS:
                return None
            if k == len(order):
                return True
            state = (k, *sorted(rooms))
            if state in failed:
                return False
            size = sizes[order[k]]
            for room in sorted({r for r in rooms if r >= size}):
                g = rooms.index(room)
                rooms[g] -= size
                held[g].append(order[k])
                if (done := place(k + 1)) is not False:
                    return done
                held[g].pop()
                rooms[g] += size
            failed.add(state)
            return False

        done = place(0)
        if done:
            return [h for h in held if h], True
        if done is None:
            return groups, False
    return groups, True


def zipped(members: dict[str, bytes], index: list[dict], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    """A ZIP of members with their index; times are fixed, so equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in [*members.items(), (INDEX, json.dumps(index, ensure_ascii=False, separators=(",", ":")).encode())]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = method
            z.writestr(info, data)
    return out.getvalue()


def probe(data: bytes, samples: int = 16, size: int = 256 << 10) -> float:
    """Estimated compressed share of a text from up to so many samples: its first and last bytes and places between them."""
    if not data:
        return 1.0
    n = min(samples, -(-len(data) // size))
    starts = [round(k * (len(data) - size) / max(1, n - 1)) if n > 1 else 0 for k in range(n)]
    parts = [data[max(0, s) : max(0, s) + size] for s in starts]
    return sum(len(zlib.compress(p)) for p in parts) / sum(map(len, parts))


def strategy(raw: int, estimate: float, cap: int) -> str:
    """one: as it is below the cap; try: probably below it when compressed; parts: cut and packed."""
    return "one" if raw <= cap else "try" if raw * estimate < 0.9 * cap else "parts"


def ranged(data: bytes, cap: int) -> list[tuple[int, int, int]]:
    """(start, end, compressed bytes) of pieces whose compressed size stays below the cap; targets shrink until it does."""
    out, at, target = [], 0, max(4, int(cap / max(probe(data), 1e-6) * 0.98))
    while at < len(data):
        piece = cut(data[at : at + target + 4], target)[0]
        packed = len(zlib.compress(data[at : at + piece[1]]))
        if packed <= cap:
            out.append((at, at + piece[1], packed))
            at += piece[1]
        elif target <= 4:
            raise ValueError("the cap is too small for one character")
        else:
            target = max(4, min(piece[1] - 1, int(piece[1] * cap / packed * 0.96)))
    return out


def planned(members: list[tuple[int, bytes]], cap: int) -> tuple[list[list[tuple[int, int, int, int]]], bool]:
    """Parts of one set: lists of (position, start, end, original bytes); a piece counts with its headers and index entry."""
    room = cap - END_BYTES - MEMBER_BYTES
    extra = MEMBER_BYTES + ENTRY_BYTES
    pieces, sizes = [], []
    for k, (_, data) in enumerate(members):
        for start, end, packed in ranged(data, room - extra) or [(0, 0, 8)]:
            pieces.append((k, start, end, len(data)))
            sizes.append(packed + extra)
    groups, proved = fewest_groups(sizes, room)
    return [[pieces[i] for i in sorted(g)] for g in groups], proved


ARCHIVED = "session_id string, set_no bigint, part_no int, parts int, proved boolean, data binary"


def archives(members: DataFrame, cap: int, set_bytes: int = SET_BYTES) -> DataFrame:
    """ARCHIVED: the members of each session in ZIP parts of at most cap bytes.

    A session's members, in order, are cut into sets of about set_bytes, so that one with a third of all bytes is spread;
    parts are numbered within their set."""
    sizes = materialize(members.select("session_id", "member_id", F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("size")), "sizes")
    upto = running(sizes, ["session_id"], "member_id", {"upto": ("sum", F.col("size"))})
    sets = upto.select(F.col("session_id").alias("s"), F.col("member_id").alias("m"), F.floor((F.col("upto") - F.col("size")) / set_bytes).alias("set_no")).distinct()
    rows = members.select("session_id", "member_id", "original", "body").join(sets, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("member_id") == F.col("m")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["member_id"].to_pylist(), table["original"].to_pylist(), table["body"].to_pylist()))
        given = [(i, (body or "").encode()) for i, _, body in rows]
        parts, proved = planned(given, cap) if given else ([], True)
        out = []
        for no, part in enumerate(parts, 1):
            held, index = {}, []
            for k, start, end, size in part:
                i, data = given[k]
                name = f"{i:08d}-{start:012d}.bytes"
                held[name] = data[start:end]
                index.append({"member": name, "id": i, "offset": start, "bytes": end - start, "sha256": hashlib.sha256(data[start:end]).hexdigest(), "original_bytes": size, "original_sha256": hashlib.sha256(data).hexdigest()})
            out.append((key[0].as_py(), key[1].as_py(), no, len(parts), proved, zipped(held, index)))
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.table({c.split()[0]: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(ARCHIVED.split(", "), types))})

    return rows.select("session_id", "set_no", "member_id", "original", "body").groupBy("session_id", "set_no").applyInArrow(run, ARCHIVED)


PROBLEMS = ("unreadable", "encrypted", "duplicate_name", "unsafe_name", "bad_content", "no_index", "not_in_index", "missing_member", "wrong_hash")
CHECKED = "path string, problem string, member string, id bigint, offset bigint, bytes bigint, original_bytes bigint, original_sha256 string, data binary"


def check(data: bytes) -> list[tuple]:
    """(problem or None, member, id, offset, bytes, original bytes, original hash, content) of each member of an archive."""
    alone = lambda problem, name=None: (problem, name, None, None, None, None, None, None)
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        return [alone("unreadable")]
    infos = z.infolist()
    names = [i.filename for i in infos]
    if any(i.flag_bits & 1 for i in infos):
        return [alone("encrypted")]
    if len(set(names)) < len(names):
        return [alone("duplicate_name")]
    if bad := next((n for n in names if not n or n in (".", "..") or "/" in n or "\\" in n or "\0" in n), None):
        return [alone("unsafe_name", bad)]
    content = {}
    for n in names:
        try:
            content[n] = z.read(n)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
            return [alone("bad_content", n)]
    try:
        index = {e["member"]: e for e in json.loads(content.pop(INDEX))}
    except (KeyError, ValueError, TypeError):
        return [alone("no_index")]
    out = [alone("not_in_index", n) for n in content if n not in index]
    for n, e in index.items():
        if n not in content:
            out.append(alone("missing_member", n))
        else:
            good = len(content[n]) == e["bytes"] and hashlib.sha256(content[n]).hexdigest() == e["sha256"]
            out.append((None if good else "wrong_hash", n, e["id"], e["offset"], e["bytes"], e["original_bytes"], e["original_sha256"], content[n]))
    return out


def verified(files: DataFrame) -> DataFrame:
    """CHECKED of archives read as (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = check(data)
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHECKED.split(", ")])

    return files.select("path", "content").mapInArrow(run, CHECKED)


def inventory_digest(rows: DataFrame, name: str, sha256: str, size: str, *keys: str) -> DataFrame:
    """One hash over the sorted [name, sha256, bytes] rows of each key, as JSON without spaces; hashed as the rows stream by."""
    one = F.to_json(F.array(F.col(name).cast("string"), F.col(sha256), F.col(size).cast("string")))
    flat = rows.select(*keys, F.col(name).cast("string").alias("_name"), F.encode(F.concat(one, F.lit("\n")), "utf-8").alias("_row"))
    return ordered_sha256(flat, {k: pa.string() for k in keys}, ["_name"], "_row")
