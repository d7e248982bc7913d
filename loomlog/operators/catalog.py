"""Reconciliation of the session catalog with the sessions found in the logs; listings, sorts and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import text as X

# Short forms and default directions of sort fields.
SORT_ALIASES = {"recent": "updated_at:desc", "oldest": "created_at:asc", "name": "title:asc"}
DESCENDING = {"updated_at", "created_at", "size", "lines"}


def seen_sessions(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions found in either log, with rows, first and last arrival; pre-aggregated per log before the union meets."""
    one = lambda df, name: df.where("session_id is not null").groupBy("session_id").agg(
        F.lit(name).alias("log"), F.count("*").alias("rows"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen")
    )
    both = one(lines, "rollout").unionByName(one(items, "legacy"))
    # a session in both logs counts once, under the log that saw it last
    return both.groupBy("session_id").agg(
        F.max_by("log", F.struct("last_seen", "log")).alias("log"), F.sum("rows").alias("rows"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def reconciled(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full outer join of both sides with what each lacks filled from the other."""
    c = catalog.where("session_id is not null").withColumn("in_catalog", F.lit(True))
    s = seen.withColumn("available", F.lit(True))
    return s.join(c, "session_id", "full_outer").select(
        "session_id",
        F.coalesce("available", F.lit(False)).alias("available"),
        F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), "session_id").alias("title"),
        F.coalesce("updated_at", "last_seen").alias("updated_at"),
        F.coalesce("archived", F.lit(0)).alias("archived"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "cwd",
        "project_id",
        "source",
    )


def sort_columns(spec: str, ordinal: str) -> list[Column]:
    """Sort order of a spec such as ``title:asc,rows:desc``, ``+title,-rows`` or ``recent``.

    Nulls come last in both directions; ties keep the order of ordinal, ascending."""
    out = []
    for part in SORT_ALIASES.get(spec, spec).split(","):
        m = re.fullmatch(r"([+-]?)(\w+)(?::(asc|desc))?", part.strip())
        if not m:
            raise ValueError(f"no sort field: {part!r}")
        sign, name, way = m.groups()
        down = way == "desc" or sign == "-" or (not way and not sign and name in DESCENDING)
        column = F.col(name)
        out.append(column.desc_nulls_last() if down else column.asc_nulls_last())
    return [*out, F.col(ordinal).asc()]


def all_words(query: str, *columns: str) -> Column:
    """Every word of the query occurs, whatever the case, in the concatenation of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for word in query.lower().split():
        out &= hay.contains(word)
    return out


def projects(catalog: DataFrame) -> DataFrame:
    """Sessions by workspace: count, archived, latest update."""
    key = X.project_key("cwd", "project_id")
    return catalog.where("session_id is not null").groupBy(key.alias("project")).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("archived") == 1).alias("archived"), F.max("updated_at").alias("updated_at")
    )


STATUSES = ("all", "available", "live", "archived", "missing")


def has_status(status: str) -> Column:
    """Rows of reconciled() with a status; live is available and not archived."""
    if status not in STATUSES:
        raise ValueError(f"no status: {status}")
    archived, available = F.col("archived") == 1, F.col("available")
    return {"all": F.lit(True), "available": available, "live": available & ~archived, "archived": archived, "missing": ~available}[status]


def in_project(target: str) -> Column:
    """Sessions of a project: a path is compared whole, a name with the last part of the workspace and the project id."""
    if "\\" in target or ":" in target:
        return X.path_key("cwd") == X.normal_path(target)
    return (F.substring_index(X.path_key("cwd"), "\\", -1) == target.lower()) | (F.lower(F.coalesce("project_id", F.lit(""))) == target.lower())


def session_metadata(lines: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """session_id, field, values: distinct values of each field in the order in which they were first seen.

    fields names, for each, the JSON paths that may hold it; a value counts at its first line, so only first sights are collected."""
    each = F.array(*(F.struct(F.lit(name).alias("field"), F.trim(F.get_json_object("raw", path)).alias("value"), F.lit(k).alias("k")) for name, paths in fields.items() for k, path in enumerate(paths)))
    rows = lines.select("session_id", "line_no", F.inline(each)).where("value <> ''")
    first = rows.groupBy("session_id", "field", "value").agg(F.min(F.struct("line_no", "k")).alias("at"))
    return first.groupBy("session_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
