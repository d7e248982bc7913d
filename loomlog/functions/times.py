"""Date and time scalars."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, functions as F


def display(column: str, zone: str = "UTC") -> Column:
    """Month D, YYYY at hh:mm:ss AM/PM ZONE."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(F.col(column).isNotNull(), F.concat(F.date_format(local, "MMMM d, yyyy 'at' hh:mm:ss a"), F.lit(f" {zone}")))


def since(day: str, zone: str = "UTC") -> Column:
    """Instant of a day's local midnight."""
    return F.to_utc_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp"), zone)


def epoch_seconds(column: str) -> Column:
    return F.unix_micros(column) / 1e6


_DATE_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_LEAST, _MOST = -62_135_596_800.0, 253_402_300_800.0


def parsed(column: str) -> Column:
    """Instant of an ISO date-time with Z or an offset, or of Unix seconds (never milliseconds); anything else is null."""
    text = F.regexp_replace(F.trim(column), ",(?=\\d)", ".")
    iso = F.when(text.rlike(rf"^{_DATE_TIME}(?:[Zz]|[+-]\d{{2}}(?::?\d{{2}})?)$"), F.regexp_replace(F.upper(text), r"([+-]\d{2})(\d{2})$", "$1:$2")).try_cast("timestamp")
    number = F.when(text.rlike(_NUMBER), text).try_cast("double")
    return F.coalesce(iso, F.timestamp_seconds(F.when((number >= _LEAST) & (number < _MOST), number)))


def naive(column: str) -> Column:
    """Wall time of an ISO date-time without an offset; anything else is null."""
    text = F.regexp_replace(F.trim(column), ",(?=\\d)", ".")
    return F.when(text.rlike(rf"^{_DATE_TIME}$"), text).try_cast("timestamp_ntz")


def sort_key(column: str) -> Column:
    """Seconds since 1970 by which times are sorted; a wall time counts as UTC."""
    wall = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), naive(column)).cast("timestamp"))
    return F.coalesce(F.unix_micros(parsed(column)), wall) / 1e6


def zone_of(spec: str, source: str | None = None) -> str:
    """The zone of a spec: UTC, source (the zone given), an offset up to 23:59, or an IANA name; anything else raises."""
    given = spec.strip()
    if given.lower() == "source":
        return source or "UTC"
    m = re.fullmatch(r"(?i)(?:UTC)?([+-])(\d{2}):?(\d{2})", given)
    if m:
        if int(m[2]) > 23 or int(m[3]) > 59:
            raise ValueError(f"no offset: {spec}")
        return f"{m[1]}{m[2]}:{m[3]}"
    if given.upper() in ("UTC", "Z"):
        return "UTC"
    try:
        return ZoneInfo(given).key
    except (ZoneInfoNotFoundError, ValueError):
        raise ValueError(f"no time zone: {spec}") from None


def local_wall(column: str, zone: str | Column) -> Column:
    """Wall time of an instant in a zone, which may differ from row to row."""
    at = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, at)


def local_display(column: str, zone: str | Column) -> Column:
    """Month D, YYYY at hh:mm:ss AM/PM in a zone, with its name."""
    name = F.lit(zone) if isinstance(zone, str) else zone
    return F.concat(F.date_format(local_wall(column, zone), "MMMM d, yyyy 'at' hh:mm:ss a"), F.lit(" "), name)
