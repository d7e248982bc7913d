"""Mixed timestamp notations and zones to one UTC instant.

Each value is reduced to a character-class shape mask (digit 9, upper A, lower a, everything else itself).
Every distinct mask is compiled once to a parser: the positions of its fields.  All values of a mask are then
converted together on a code-point matrix, and wall times go through zone transition tables built from the
installed, versioned tz database.  Values are laid out in matrices by length class, so one very long value costs its
own row only, and no length is too long.

Defined results for odd input: null, empty and unknown notations, impossible dates or times, skipped
wall times and unknown zones give no instant; digits after the microsecond are cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomlog.storage import materialize

DAY, US = 86_400, 1_000_000
NONE = np.iinfo(np.int64).min

# Month names, day names, zone abbreviations of the US and Europe with their minutes from UTC.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
}
_MONTH = {m[:n]: i + 1 for i, m in enumerate(MONTHS) for n in {3, len(m)}} | {"sept": 9}

_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_OFFSET = r"(?:(?P<z>[Aa])|(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?)"
_REGION = r"(?P<region>\[[Aa][Aa/_+9-]*\])"
_AMPM = r"(?: ?(?P<ap>AA|aa)(?![Aa]))"
_ZONE = r"(?: ?(?=[Aa+-])(?P<abbr>[Aa]{1,5})?(?:(?P<sign>[+-])(?P<oh>99?)(?::?(?P<om>99))?)?)"
#: Grammar of masks; the names say what a field is.
NOTATIONS = [
    re.compile(p)
    for p in (
        rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?P<t>[Aa ]){_TIME}(?: ?{_OFFSET})?{_REGION}?",
        rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?P<t>[Aa ]){_TIME}{_AMPM}?{_ZONE}?",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<t>[Aa ])(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9+))?{_OFFSET}?",
        rf"(?P<m>99?)/(?P<d>99?)/(?P<Y>9999),? {_TIME}{_AMPM}?{_ZONE}?",
        rf"(?P<Y>9999)/(?P<m>99?)/(?P<d>99?),? {_TIME}{_AMPM}?{_ZONE}?",
        rf"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999),? {_TIME}{_AMPM}?{_ZONE}?",
        rf"(?:(?P<wd>Aaa),? )?(?P<d>99?)[ -](?P<mon>A[Aa]{{2,8}})[ -](?P<Y>9999) {_TIME}{_AMPM}?{_ZONE}?",
        rf"(?P<mon>A[Aa]{{2,8}})\.? (?P<d>99?),? (?P<Y>9999)(?: (?P<at>aa)|,)? {_TIME}{_AMPM}?{_ZONE}?",
    )
]
NUMBER = re.compile(r"(?P<n>9{1,18})(?:\.(?P<f>9+))?")


@lru_cache(maxsize=4096)
def notation(mask: str) -> dict[str, tuple[int, int]] | None:
    """The parser of a mask: field name to (start, end); None for masks of no notation."""
    for p in (NUMBER, *NOTATIONS):
        if m := p.fullmatch(mask):
            return {k: m.span(k) for k in m.groupdict() if m.group(k)}
    return None


def zone_version() -> str:
    """Version of the tz database that the transition tables come from."""
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:
        return "system"


#: Rules repeat after the 400 years of the calendar: from CYCLE on a table holds one such period.
CYCLE, PERIOD = 2100, 146_097 * DAY * US


@lru_cache(maxsize=None)
def transitions(zone: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants of change, offsets) in microseconds; offset i holds before instant i.  None: no such zone.

    Covers the years 1800 to CYCLE + 400; later ones are carried back by whole periods."""
    try:
        z = ZoneInfo(zone)
    except Exception:
        return None
    at = lambda s: round(datetime.fromtimestamp(s, timezone.utc).astimezone(z).utcoffset().total_seconds())
    start = lambda y: int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp())
    s, instants = start(1800), []
    offsets = [at(s)]
    # changes lie close together only while they are decreed one by one
    for end, step in ((start(1900), 30 * DAY), (start(CYCLE), 10 * DAY), (start(CYCLE + 400), 30 * DAY)):
        while s < end:
            if (now := at(s + step)) != offsets[-1]:
                a, b = s, s + step
                while b - a > 1:
                    c = (a + b) // 2
                    a, b = (c, b) if at(c) == offsets[-1] else (a, c)
                instants.append(b)
                offsets.append(now)
            s += step
    return np.array(instants, dtype=np.int64) * US, np.array(offsets, dtype=np.int64) * US


def wall_to_utc(wall: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earliest and latest instant of wall times, and the change between them if they differ; NONE where there is none."""
    none = np.full(len(wall), NONE)
    if (table := transitions(zone, zone_version())) is None:
        return none, none, none
    instants, offsets = table
    lead = int(datetime(CYCLE + 399, 1, 1, tzinfo=timezone.utc).timestamp()) * US
    back = np.maximum(-(-(wall - lead) // PERIOD), 0) * PERIOD
    wall = wall - back
    low = np.concatenate([[-(2**62)], instants])
    high = np.concatenate([instants, [2**62]])
    first = np.searchsorted(instants, wall - DAY * US)
    early, late, change = none.copy(), none.copy(), none.copy()
    for k in range(4):
        i = np.minimum(first + k, len(instants))
        u = wall - offsets[i]
        fits = (u >= low[i]) & (u < high[i]) & (first + k <= len(instants))
        change = np.where(fits & (early != NONE), low[i], change)
        late = np.where(fits & (early != NONE), u, late)
        early = np.where(fits & (early == NONE), u, early)
    return tuple(np.where(x == NONE, NONE, x + back) for x in (early, late, change))


def days_since_1970(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Civil date to day number; rows must hold possible months."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _number(codes: np.ndarray, span: tuple[int, int] | None, empty: int = 0) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    if span is None:
        return out + empty
    for k in range(*span):
        out = out * 10 + (codes[:, k].astype(np.int64) - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int], value) -> np.ndarray:
    """value(word) of each row's word, worked out once for each distinct word; None becomes NONE."""
    cut = np.ascontiguousarray(codes[:, slice(*span)])
    words = cut.view(f"U{span[1] - span[0]}").ravel()
    distinct, back = np.unique(words, return_inverse=True)
    return np.array([NONE if (v := value(str(w))) is None else v for w in distinct], dtype=np.int64)[back]


def _fraction(codes: np.ndarray, span: tuple[int, int] | None, digits: int) -> np.ndarray:
    """The first digits of a fraction as a whole number of units of 10**-digits."""
    if span is None:
        return np.zeros(len(codes), dtype=np.int64)
    end = min(span[1], span[0] + digits)
    return _number(codes, (span[0], end)) * 10 ** (digits - (end - span[0]))


def _convert(codes: np.ndarray, at: dict[str, tuple[int, int]], zones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(early, late, change) of the rows of one mask."""
    n = len(codes)
    early, late, change = (np.full(n, NONE) for _ in range(3))
    if "n" in at:
        v = _number(codes, at["n"])
        unit = np.where(v < 10**11, 6, np.where(v < 10**14, 3, 0))
        for p in (6, 3, 0):
            early = np.where(unit == p, np.where(unit == p, v, 0) * 10**p + _fraction(codes, at.get("f"), p) if p else v, early)
        return early, late, change
    y, d = _number(codes, at["Y"]), _number(codes, at["d"])
    m = _words(codes, at["mon"], lambda w: _MONTH.get(w.lower())) if "mon" in at else _number(codes, at["m"])
    hour, minute, second = (_number(codes, at.get(k)) for k in "HMS")
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    m = np.where(ok, m, 1)
    y = np.where(ok, y, 1970)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok &= d <= np.where(m == 2, 28 + leap, 30 + ((m + m // 8) % 2))
    if "t" in at:
        t = codes[:, at["t"][0]]
        ok &= (t == ord("T")) | (t == ord("t")) | (t == ord(" "))
    if "at" in at:
        ok &= _words(codes, at["at"], lambda w: 1 if w == "at" else 0) == 1
    if "ap" in at:
        half = _words(codes, at["ap"], lambda w: {"AM": 0, "PM": 12}.get(w.upper()))
        ok &= (half != NONE) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == NONE, 0, half)
    days = days_since_1970(y, m, d)
    if "wd" in at:
        ok &= _words(codes, at["wd"], lambda w: DAYS.index(w.lower()) if w.lower() in DAYS else None) == (days + 3) % 7
    wall = (days * DAY + hour * 3600 + minute * 60 + second) * US + _fraction(codes, at.get("f"), 6)
    offset = None
    if "z" in at:
        z = codes[:, at["z"][0]]
        ok &= (z == ord("Z")) | (z == ord("z"))
        offset = np.zeros(n, dtype=np.int64)
    elif "abbr" in at:
        minutes = _words(codes, at["abbr"], lambda w: ABBREVIATIONS.get(w.upper()))
        ok &= minutes != NONE
        offset = np.where(minutes == NONE, 0, minutes)
        if "sign" in at:
            ok &= offset == 0
    if "sign" in at:
        oh, om = _number(codes, at["oh"]), _number(codes, at.get("om"))
        ok &= (oh <= 23) & (om <= 59)
        offset = np.where(codes[:, at["sign"][0]] == ord("-"), -1, 1) * (oh * 60 + om)
    if offset is not None:
        return np.where(ok, wall - offset * 60 * US, NONE), late, change
    names = zones
    if "region" in at:
        s, e = at["region"]
        names = np.ascontiguousarray(codes[:, s + 1 : e - 1]).view(f"U{e - s - 2}").ravel().astype(object)
    for zone in {x for x in names[ok] if x}:
        rows = np.flatnonzero(ok & (names == zone))
        early[rows], late[rows], change[rows] = wall_to_utc(wall[rows], zone)
    return early, late, change


def parse(values: list[str | None], zones: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(early, late, change, plain) of values whose wall times belong to zones.

    plain: written as YYYY-MM-DDTHH:MM:SS[.fraction]Z exactly.  late and change are set only for wall times
    that occur twice."""
    n = len(values)
    stripped = [v.strip() if v is not None else "" for v in values]
    early, late, change = (np.full(n, NONE) for _ in range(3))
    plain = np.zeros(n, dtype=bool)
    # the length class of a value is the power of two that holds it, so no matrix is more than twice as wide as its rows
    bits = np.array([len(s).bit_length() if s and s.isascii() and "\0" not in s else 0 for s in stripped], dtype=np.int64)
    for k in np.unique(bits[bits > 0]):
        rows, width = np.flatnonzero(bits == k), 1 << int(k)
        most = max(1, (1 << 24) // width)
        for at in range(0, len(rows), most):
            _parse_rows(rows[at : at + most], width, values, stripped, zones, (early, late, change, plain))
    return early, late, change, plain


_CLASSES = np.arange(128, dtype=np.uint8)
for _first, _last, _to in (("0", "9", "9"), ("A", "Z", "A"), ("a", "z", "a")):
    _CLASSES[ord(_first) : ord(_last) + 1] = ord(_to)


def _parse_rows(rows: np.ndarray, width: int, values: list, stripped: list[str], zones: list, out: tuple) -> None:
    """Values of one length class: masks, then each mask's values together."""
    early, late, change, plain = out
    codes = np.array([stripped[i] for i in rows], dtype=f"U{width}").view(np.uint32).reshape(len(rows), width)
    masks, back = np.unique(_CLASSES[codes].view(f"S{width}").ravel(), return_inverse=True)
    order = np.argsort(back, kind="stable")
    bounds = np.searchsorted(back[order], np.arange(len(masks) + 1))
    zone = np.array([zones[i] for i in rows], dtype=object)
    bare = np.array([len(values[i]) == len(stripped[i]) for i in rows], dtype=bool)
    for k, mask in enumerate(masks):
        if (at := notation(mask.decode())) is None:
            continue
        own = order[bounds[k] : bounds[k + 1]]
        early[rows[own]], late[rows[own]], change[rows[own]] = _convert(codes[own], at, zone[own])
        if re.fullmatch(rb"9999-99-99A99:99:99(\.9+)?A", mask):
            last = len(mask) - 1
            plain[rows[own]] = bare[own] & (codes[own, 10] == ord("T")) & (codes[own, last] == ord("Z"))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        early, late, change, plain = parse(b.column("timestamp").to_pylist(), b.column("zone").to_pylist())
        number = lambda x: pa.array(x, mask=x == NONE)
        yield pa.RecordBatch.from_arrays(
            [b.column("line_id"), b.column("session_id"), b.column("line_no"), b.column("block"), number(early), number(late), number(change), pa.array(plain)],
            names=["line_id", "session_id", "line_no", "block", "early", "late", "change", "plain"],
        )


PARSED = "line_id bigint, session_id string, line_no bigint, block bigint, early bigint, late bigint, change bigint, plain boolean"


def normalise(lines: DataFrame, catalog: DataFrame, block_lines: int = 4096) -> DataFrame:
    """line_id, session_id, line_no, utc_us (null: undetermined), plain: one row for each row of lines.

    lines: line_id, session_id, line_no, timestamp; catalog: session_id, local_zone.  Further columns are ignored.
    A wall time that occurs twice takes its earlier instant unless a line of its session with a smaller line_no lies
    after that; then the later.  Sessions are cut into blocks of block_lines line numbers, so a session that holds a
    third of all rows is spread; only block maxima and the doubtful rows ever meet across blocks.
    A line without session or line_no has no zone and no predecessors; several catalog rows of a session count as one
    if they agree on the zone, else the smallest name counts.
    """
    rows = lines.select(
        "line_id", "session_id", "line_no", "timestamp", F.coalesce(F.floor(F.col("line_no") / block_lines), F.lit(-1)).alias("block")
    )
    zones = catalog.where("session_id is not null and local_zone is not null").groupBy("session_id").agg(F.min("local_zone").alias("zone"))
    blocks = rows.where("session_id is not null").select("session_id", "block").distinct().join(zones, "session_id")
    known = rows.join(blocks, ["session_id", "block"], "left")
    parsed = materialize(known.select("line_id", "session_id", "line_no", "block", "timestamp", "zone").mapInArrow(_parse_batches, PARSED), "instants")

    doubtful = parsed.where("late is not null")
    tops = parsed.where("early is not null and session_id is not null and line_no is not null").join(
        doubtful.select("session_id").distinct(), "session_id", "left_semi"
    )
    across = W.partitionBy("session_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = tops.groupBy("session_id", "block").agg(F.max("early").alias("top")).withColumn("before", F.max("top").over(across)).drop("top")
    within = W.partitionBy("session_id", "block").orderBy("line_no").rangeBetween(W.unboundedPreceding, -1)
    hot = tops.join(doubtful.select("session_id", "block").distinct(), ["session_id", "block"], "left_semi")
    seen = hot.withColumn("inside", F.max("early").over(within)).where("late is not null").join(before, ["session_id", "block"], "left")
    seen = seen.withColumn("passed", F.coalesce(F.greatest("inside", "before") > F.col("early"), F.lit(False)))
    # once one line is past the change, all later lines that could lie on either side of it are past it too
    since = seen.where("passed").groupBy("session_id", "change").agg(F.min("line_no").alias("since"))
    settled = seen.join(since, ["session_id", "change"], "left").select(
        "line_id", F.when(F.col("passed") | F.coalesce(F.col("line_no") > F.col("since"), F.lit(False)), F.col("late")).otherwise(F.col("early")).alias("utc_us")
    )
    alone = doubtful.where("session_id is null or line_no is null").select("line_id", F.col("early").alias("utc_us"))
    sure = parsed.where("late is null").select("line_id", "session_id", "line_no", F.col("early").alias("utc_us"), "plain")
    rest = doubtful.select("line_id", "session_id", "line_no", "plain").join(settled.unionByName(alone), "line_id").select(sure.columns)
    return sure.unionByName(rest)


def found(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """line_id, utc_us of lines with one instant that are not already written in the plain form."""
    return normalise(lines, catalog).where("utc_us is not null and not plain").select("line_id", "utc_us")
