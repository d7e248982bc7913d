"""Text scalars as column expressions: counting, cleaning, redaction, previews, paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns and replacements of the redaction steps, in order.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_\-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_PAT]"),
    (r"gh[pousr]_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{20,}", "$1[REDACTED_TOKEN]"),
    (r"(?i)(password|passwd|token|secret|api[_-]?key)(\s*[:=]\s*)([^\s'\";]+)", "$1$2[REDACTED]"),
    (r"(?i)(cloudflare[_-]?tunnel[_-]?token)(\s*[:=]\s*)([^\s'\";]+)", "$1$2[REDACTED]"),
]
# Terminal sequences, control characters, truncation markers, mojibake letters and Windows-1252 characters.
OSC = r"\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)"
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
TRUNCATED = r"(?i)…([0-9,]+)\s+tokens truncated…"
MOJIBAKE = "[ÆæôöâäÖÜ]"
CP1252 = "".join(bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0xA0))
CP1252_CODES = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))


def tokens(text: str) -> Column:
    """Estimated tokens: words and single marks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")), F.lit(0)).cast("bigint")


def lines(text: str) -> Column:
    """Lines; a final line end does not begin another one."""
    n = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    last = F.when(F.col(text).endswith("\n") | F.col(text).endswith("\r"), 0).otherwise(1)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n + last).cast("bigint")


def collapsed(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: str, limit: int = 120) -> Column:
    one = collapsed(text)
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…"))).otherwise(one)


def search_key(text: str) -> Column:
    """Whitespace collapsed, case folded."""
    return F.replace(F.lower(collapsed(text)), F.lit("ß"), F.lit("ss"))


def redacted(text: str) -> Column:
    out = F.col(text)
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out


def without_controls(text: str) -> Column:
    """Title sequences, then colour sequences, then control characters removed."""
    out = F.col(text)
    for pattern in (OSC, ANSI, CONTROL):
        out = F.regexp_replace(out, pattern, "")
    return out


def mojibake_repaired(text: str) -> Column:
    return F.when(F.col(text).rlike(MOJIBAKE), F.translate(text, CP1252_CODES, CP1252)).otherwise(F.col(text))


def truncation_markers(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TRUNCATED)), F.lit(0)).cast("bigint")


def truncated_tokens(text: str) -> Column:
    """Sum of the token counts that truncation markers state."""
    found = F.regexp_extract_all(text, F.lit(TRUNCATED), 1)
    return F.coalesce(F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.replace(x, F.lit(","), F.lit("")).cast("bigint")), F.lit(0))


def cards(text: str, label: str) -> Column:
    """Lines that are a file card's label."""
    return F.regexp_count(text, F.lit(f"(?m)^{label}$")).cast("bigint")


def slug(text: str, limit: int = 80) -> Column:
    out = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s.-]+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "_"), "_+", "_")
    ends = r"^[._\- ]+|[._\- ]+$"
    out = F.regexp_replace(out, ends, "")
    out = F.when(F.coalesce(out, F.lit("")) == "", "thread").otherwise(out)
    return F.regexp_replace(F.substring(out, 1, limit), ends, "")


def human_size(size: str) -> Column:
    v = F.col(size).cast("double")
    scaled = lambda k, unit: F.concat(F.format_string("%.1f", v / 1024**k), F.lit(unit))
    return (
        F.when(v < 1024, F.concat(F.col(size).cast("bigint").cast("string"), F.lit("B")))
        .when(v < 1024**2, scaled(1, "KB"))
        .when(v < 1024**3, scaled(2, "MB"))
        .when(v < 1024**4, scaled(3, "GB"))
        .when(v.isNotNull(), scaled(4, "TB"))
    )


def path_key(path: str | Column) -> Column:
    """One separator, long-path prefixes and trailing separators removed, case folded."""
    given = F.col(path) if isinstance(path, str) else path
    p = F.replace(F.trim(F.coalesce(given, F.lit(""))), F.lit("/"), F.lit("\\"))
    p = F.when(p.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substr(p, F.lit(9)))).when(p.startswith("\\\\?\\"), F.substr(p, F.lit(5))).otherwise(p)
    return F.lower(F.regexp_replace(p, r"\\+$", ""))


def normal_path(path: str) -> Column:
    """The key of one path that a user gives."""
    return path_key(F.lit(path))


def project_key(cwd: str, project: str) -> Column:
    """path:, id: or name: key of a workspace; case is folded for drive and share paths only."""
    p = F.regexp_replace(F.replace(F.coalesce(F.col(cwd), F.lit("")), F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    p = F.when(p.rlike("^(?:[A-Za-z]:(?:/|$)|//)"), F.lower(p)).otherwise(p)
    return F.when(p != "", F.concat(F.lit("path:"), p)).when(F.coalesce(F.col(project), F.lit("")) != "", F.concat(F.lit("id:"), F.col(project))).otherwise("name:(unknown project)")


def fence(text: str) -> Column:
    """A run of backticks longer than any in the text, at least three."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def without_transport_header(text: str | Column) -> Column:
    """Tool output without its leading transport lines."""
    return F.regexp_replace(text, r"^(?:(?:Chunk ID|Wall time|Process exited with code|Original token count)[^\n]*\n){0,7}Output:\n?", "")


def exit_code(text: str) -> Column:
    return F.regexp_extract(text, r"^(?:(?:Chunk ID|Wall time|Original token count)[^\n]*\n){0,7}Process exited with code (-?\d+)", 1).try_cast("int")


def command_key(command: str | Column) -> Column:
    return F.lower(collapsed(command))


# Names that no file may have, whatever its ending, and characters that no file name may hold.
DEVICE_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))]
RESERVED = r'[<>:"/\\|?*\x00-\x1f]'


def file_name(text: str, limit: int = 220, ending: str = ".md") -> Column:
    """A name as one portable file name of at most limit characters; an ending it has already is not doubled."""
    stem = F.when(F.lower(text).endswith(ending), F.expr(f"substring({text}, 1, length({text}) - {len(ending)})")).otherwise(F.coalesce(F.col(text), F.lit("")))
    stem = F.regexp_replace(F.regexp_replace(stem, RESERVED, "_"), r"\s+", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, r"^[ ._]+|[ ._]+$", ""), "_+", "_")
    stem = F.when(stem == "", "thread").otherwise(stem)
    stem = F.when(F.upper(F.substring_index(stem, ".", 1)).isin(DEVICE_NAMES), F.concat(F.lit("_"), stem)).otherwise(stem)
    cut = F.regexp_replace(F.substring(stem, 1, limit - len(ending)), r"[ ._]+$", "")
    return F.concat(F.when(cut == "", "thread").otherwise(cut), F.lit(ending))


def from_template(template: str, values: dict[str, Column]) -> Column:
    """A template such as ``{title}_{mode}`` with its places filled; a place without a value raises."""
    parts = re.split(r"\{(\w+)\}", template)
    if unknown := set(parts[1::2]) - values.keys():
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def yaml_quoted(text: str) -> Column:
    escaped = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def markdown_row(*columns: str) -> Column:
    """A table row; line feeds become blanks and bars are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def language_guess(text: str) -> Column:
    """The fence language that a text's beginning or words suggest."""
    t = F.regexp_replace(text, r"^[\s\p{Z}]+", "")
    has = lambda *words: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    return (
        F.when(t.startswith("{") | t.startswith("["), "json").when(t.startswith("diff --git") | t.startswith("@@ "), "diff")
        .when(t.startswith("import ") | has("export function ", "const "), "ts").when(t.startswith("$ ") | has("$ErrorActionPreference", "Get-Content ", "npm run "), "ps1").otherwise("text")
    )


def truncation_annotated(text: str) -> Column:
    """Truncation markers written out as what they mean."""
    return F.regexp_replace(text, TRUNCATED, "[SOURCE TOOL OUTPUT TRUNCATED: $1 tokens omitted; not recoverable from this record]")


def redaction_counts(text: str) -> Column:
    """How often each redaction step applies to the text that enters it."""
    out, counts = F.col(text), []
    for pattern, to in REDACTIONS:
        counts.append(F.regexp_count(out, F.lit(pattern)))
        out = F.regexp_replace(out, pattern, to)
    return F.array(*counts)


def number_key(text: str) -> Column:
    """A number out of a text with thousands separators; null if it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
