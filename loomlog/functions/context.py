"""Predicates on injected context and small parsers of user expressions.

A user message counts as context only if it is nothing but closed envelopes; any text behind one makes it a request.  Tags are
data: the lists below hold those without a host's name, and callers add the exact tags of their own host."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Envelopes that hosts inject, service tags with the attribute they need, and the heading of instruction blocks.
ENVELOPES = ("environment_context", "permissions instructions", "collaboration_mode", "user_instructions", "environments_instructions")
SERVICE = (("in-app-browser-context", "source", ("ambient-ui-state",)), ("turn_aborted", None, ()))
HEADING = r"#\s*agents\.md instructions(?:[ \t]+for[^\r\n]*|[ \t]*)\r?\n\s*<instructions>(?:(?!</instructions>).)*</instructions>"


def _closed(opening: str, tag: str) -> str:
    return rf"<{opening}>(?:(?!</{tag}>).)*</{tag}>"


@lru_cache(maxsize=None)
def injected_pattern(envelopes: tuple = ENVELOPES) -> str:
    """A whole text of injected envelopes and instruction blocks."""
    kinds = "|".join([HEADING, *(_closed(re.escape(t), re.escape(t)) for t in envelopes)])
    return rf"^\s*(?:(?:{kinds})\s*)+$"


@lru_cache(maxsize=None)
def service_pattern(service: tuple = SERVICE) -> str:
    """A whole text of service envelopes.  Each is (tag, attribute or None, its possible values); tags may be patterns."""
    kinds = "|".join(_closed(rf"""{tag}\s+{name}=["'](?:{'|'.join(map(re.escape, values))})["']""" if name else tag, tag) for tag, name, values in service)
    return rf"^\s*(?:(?:{kinds})\s*)+$"


def is_injected_context(text: str, envelopes: tuple = ENVELOPES) -> Column:
    return F.coalesce(F.col(text).rlike("(?is)" + injected_pattern(envelopes)), F.lit(False))


def is_service_context(text: str, service: tuple = SERVICE) -> Column:
    return F.coalesce(F.col(text).rlike("(?is)" + service_pattern(service)), F.lit(False))


def injected_context(text: str, envelopes: tuple = ENVELOPES) -> bool:
    return text.lstrip()[:1] in ("<", "#") and re.match(injected_pattern(envelopes), text, re.I | re.S) is not None


def service_context(text: str, service: tuple = SERVICE) -> bool:
    return text.lstrip()[:1] == "<" and re.match(service_pattern(service), text, re.I | re.S) is not None


def row_numbers(expression: str, last: int) -> list[int]:
    """Sorted numbers of an expression such as ``1,3-5``; what is no range within 1..last raises."""
    if not re.fullmatch(r"\s*\d+(\s*-\s*\d+)?\s*(,\s*\d+(\s*-\s*\d+)?\s*)*", expression):
        raise ValueError(f"no row ranges: {expression!r}")
    ends = [[int(x) for x in part.split("-")] for part in expression.split(",")]
    if any(not 1 <= e[0] <= e[-1] <= last for e in ends):
        raise ValueError(f"rows go from 1 to {last}: {expression!r}")
    return sorted(set().union(*(range(e[0], e[-1] + 1) for e in ends)))
