"""What parsed JSON events say: texts, commands, outputs, media, user signals.  Plain functions for Arrow-batched passes.

Events have no fixed schema, so these walk values of any nesting.  Depth is bounded where the format bounds it; nothing
else is cut: texts are taken whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from loomlog.functions import text as X

# Names and limits of the event format.
TEXT_KEYS = ["text", "output_text", "input_text", "markdown", "message", "content", "summary", "transcript", "stdout", "stderr", "output", "result", "diff", "patch"]
WRAPPER_KEYS = ["item", "payload", "data", "event", "response"]
IMAGE_TYPES = ["image", "input_image", "output_image", "screenshot", "computer_screenshot", "image_url", "file_image"]
IMAGE_KEYS = ["image_url", "b64_json", "base64_image"]
COMMAND_KEYS = ["cmd", "command", "script", "code", "shell_command"]
COMMAND_FIELDS = [["arguments", "args"], ["command", "cmd", "shell_command", "script", "code"], ["call", "action", "input"]]
OUTPUT_FIELDS = ["output", "result", "stdout", "stderr", "text", "content", "message", "diff", "patch"]
TIMESTAMP_KEYS = ["timestamp", "time", "created_at", "createdAt", "create_time"]
TIMESTAMP_WRAPPERS = ["payload", "item", "message", "event", "record", "internal_chat_message_metadata_passthrough"]
ID_KEYS = ["id", "item_id", "message_id", "event_id", "client_id"]
SIGNAL_KEYS = ["text", "input_text", "output_text", "content", "message", "transcript"]
MEDIA_IDENTITY = ["file_id", "image_url", "audio_url", "path", "b64_json", "base64_image", "data"]
ATTACHMENTS = {
    "images": ("input_image", "image_url"), "file_ids": ("input_image", "file_id"), "local_images": ("local_image", "path"),
    "audio": ("input_audio", "audio_url"), "audio_references": ("input_audio", None), "local_audio": ("local_audio", "path"),
}
HEADER_STARTS = ("Chunk ID:", "Wall time:", "Original token count:")
TEXT_DEPTH, SIGNAL_DEPTH, HEADER_LINES = 14, 32, 8
LONGEST_LINE, LINE_END, MOST_REPEATS, HASHED_CHARACTERS = 20_000, 1200, 25, 2_000_000

# Patterns of embedded binary data, with the sizes from which they count, and of terminal titles.
_DATA = r"[A-Za-z0-9+/=\r\n_-]{512,}"
MARKDOWN_IMAGE = re.compile(rf"!\[(?P<alt>[^\]]*)\]\(\s*data:image/[A-Za-z0-9.+_-]+;base64,{_DATA}\s*\)", re.I)
HTML_SOURCE = re.compile(rf"""(?P<before>\bsrc\s*=\s*["'])data:(?P<mime>image|audio|video|application|font)/[A-Za-z0-9.+_-]+;base64,{_DATA}(?P<after>["'])""", re.I)
DATA_URI = re.compile(rf"data:(?P<mime>image|audio|video|application|font)/[A-Za-z0-9.+_-]+;base64,(?P<data>{_DATA})", re.I)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{2048,}={0,2}|[A-Za-z0-9_-]{2048,}={0,2})(?![A-Za-z0-9+/=_-])")
HEX = re.compile(r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{4096,})(?![A-Fa-f0-9])")
TITLE_RESIDUE = re.compile(r"(?m)^0;[^\n]*(?:\n|$)")
TRUNCATION = re.compile(X.TRUNCATED)
_SEQUENCES = [("osc_sequence", re.compile(X.OSC)), ("ansi_sequence", re.compile(X.ANSI)), ("control_character", re.compile(X.CONTROL)), ("terminal_title_residue", TITLE_RESIDUE)]


# ------------------------------------------------------------------------------------------------ cleaning


def sha16(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "ignore")).hexdigest()[:16]


def blob_summary(label: str, raw: str) -> str:
    """What stands for an embedded binary: its size, and a hash of its first HASHED_CHARACTERS characters (a fixed format)."""
    size = int(len(raw) * 3 / 4) if "base64" in label else len(raw)
    return f"[{label} omitted: {len(raw):,} characters, ~{size:,} bytes, sha256-prefix={sha16(raw[:HASHED_CHARACTERS])}]"


def _base64(m: re.Match) -> str:
    try:
        base64.b64decode(m.group() + "=" * (-len(m.group()) % 4))
    except binascii.Error:
        return m.group()
    return blob_summary("base64 blob", m.group())


_BLOBS = [
    ("markdown_data_image", MARKDOWN_IMAGE, lambda m: f"![{m['alt'] or 'image'}]([base64 image omitted])"),
    ("html_data_src", HTML_SOURCE, lambda m: f"{m['before']}[base64 {m['mime']} omitted]{m['after']}"),
    ("data_uri", DATA_URI, lambda m: blob_summary(f"data:{m['mime']} base64 payload", m["data"])),
    ("base64_candidate", BASE64, _base64),
    ("hex_blob", HEX, lambda m: blob_summary("hex blob", m.group())),
]


def shortened(line: str, longest: int = LONGEST_LINE, end: int = LINE_END) -> str:
    """A line above the longest, reduced to its two ends and a marker."""
    if len(line) <= longest:
        return line
    return f"{line[:end].rstrip()}\n[single overlong line truncated: {len(line):,} characters, sha256-prefix={sha16(line)}]\n{line[-end:].lstrip()}"


def cleaned(text: str | None, counts: Counter | None = None, longest: int = LONGEST_LINE, repeats: int = MOST_REPEATS) -> str:
    """Text without terminal sequences, embedded binaries, overlong lines and long runs of one line.

    counts gets, for each step, how often it applied to the text that entered it."""
    if not text:
        return ""
    counts = Counter() if counts is None else counts
    if not text.isprintable():
        for name, pattern in _SEQUENCES:
            text, n = pattern.subn("", text)
            counts[name] += n
    elif text.startswith("0;"):
        text, n = TITLE_RESIDUE.subn("", text)
        counts["terminal_title_residue"] += n
    if len(text) >= 512:  # no embedded binary is shorter
        for name, pattern, to in _BLOBS:
            text, n = pattern.subn(to, text)
            counts[name] += n
    lines = text.splitlines()
    if len(text) <= longest and len(lines) <= repeats:
        return "\n".join(lines).strip()
    out, run, last = [], 0, None
    for line in lines:
        counts["overlong_line"] += len(line) > longest
        line = shortened(line, longest)
        run, last = (run + 1 if line == last else 1), line
        if run <= repeats:
            out.append(line)
        elif run == repeats + 1:
            counts["repeated_line_run"] += 1
            out.append(f"[repeated identical line omitted after {repeats:,} repeats]")
    return "\n".join(out).strip()


def annotated(text: str, policy: str = "annotate") -> str:
    """Markers of text that was lost before: written out, kept (preserve) or refused (error)."""
    if policy == "preserve" or not TRUNCATION.search(text):
        return text
    if policy == "error":
        raise ValueError("the source marks text that was cut off")
    return TRUNCATION.sub(lambda m: f"[SOURCE TOOL OUTPUT TRUNCATED: {m[1]} tokens omitted; not recoverable from this record]", text)


# ------------------------------------------------------------------------------------------------ values and texts


def embedded(value: object) -> object | None:
    """The JSON object or list that a string holds, else None."""
    s = value.strip() if isinstance(value, str) else ""
    if s[:1] + s[-1:] in ("{}", "[]"):
        try:
            return json.loads(s)
        except (ValueError, RecursionError):
            pass
    return None


def stringified(value: object) -> str:
    """Any value as one string: lists by lines, objects as indented JSON."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(s for s in map(stringified, value) if s).strip()
    return json.dumps(value, ensure_ascii=False, indent=2) if isinstance(value, dict) else str(value)


def image_placeholder(value: dict) -> str:
    """A line that stands for an image: its type, and whether it was embedded or referred to."""
    first = lambda *keys: next((v for k in keys if (v := value.get(k))), "")
    mime, detail, url = first("mime_type", "mime", "media_type") or "image", first("detail", "quality"), first("url", "image_url")
    url = (url.get("url") or "") if isinstance(url, dict) else url
    if isinstance(url, str) and url.startswith("data:"):
        return f"[{mime} content part omitted: embedded base64 image/data URI]"
    where, how = ": url/reference present" if url else "", f", detail={detail}" if detail else ""
    return f"[{mime} content part omitted{where}{how}]"


def leaves(value: object, json_aware: bool = False, depth: int = 0) -> Iterator[str]:
    """Texts of a value in order of TEXT_KEYS, uncleaned; wrappers are opened only where these give nothing."""
    if value is None or depth > TEXT_DEPTH:
        return
    if isinstance(value, str):
        if json_aware and (inner := embedded(value)) is not None:
            yield from leaves(inner, True, depth + 1)
        else:
            yield value
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v, json_aware, depth + 1)
    elif not isinstance(value, dict):
        yield str(value)
    elif str(value.get("type") or "").lower() in IMAGE_TYPES or any(k in value for k in IMAGE_KEYS):
        yield image_placeholder(value)
    else:
        given = [t for k in TEXT_KEYS for t in leaves(value.get(k), json_aware, depth + 1) if cleaned(t)]
        for k in WRAPPER_KEYS if not given else ():
            if given := [t for t in leaves(value.get(k), json_aware, depth + 1) if cleaned(t)]:
                break
        yield from given


def text_of(value: object, json_aware: bool = False, counts: Counter | None = None, policy: str = "annotate") -> str:
    """All texts of a value, cleaned, each once, blank lines between them."""
    parts = (annotated(cleaned(t, counts), policy).strip() for t in leaves(value, json_aware))
    return "\n\n".join(dict.fromkeys(p for p in parts if p))


# ------------------------------------------------------------------------------------------------ commands and outputs

_SHELL = re.compile(r"""(?:"[^"]*pwsh(?:\.exe)?"|[A-Za-z]:\\[^\r\n]*?pwsh(?:\.exe)?|pwsh(?:\.exe)?)\s+-Command\s+([\s\S]+)""", re.I)
_STOP = re.compile(r"\$?ErrorActionPreference\s*=\s*['\"]Stop['\"]", re.I)
_EXIT = re.compile(r"Process exited with code\s+(-?\d+)")
_FILE = re.compile(r"\*\*\* (Add|Update|Delete) File:\s+(.+?)\s*$")
PATCH_ENDS = ("*** Begin Patch", "*** End Patch")


def normal_command(command: str) -> str:
    """One kind of line end; the script of a shell wrapper instead of the wrapper."""
    command = command.replace("\r\n", "\n").replace("\r", "\n").strip()
    if m := _SHELL.fullmatch(command):
        script = m[1].strip()
        command = script[1:-1].strip() if len(script) > 1 and script[0] == script[-1] and script[0] in "\"'" else script
    return command


def command_key(command: str) -> str:
    return " ".join(normal_command(command).split()).lower()


def enveloped_command(value: object) -> str:
    """The command inside an arguments value: of a JSON string, an object under one of COMMAND_KEYS or argv, a list of words."""
    if isinstance(value, str):
        inner = embedded(value)
        return value if inner is None else enveloped_command(inner)
    if isinstance(value, list):
        return " ".join(map(stringified, value))
    if not isinstance(value, dict):
        return stringified(value)
    for k in [*COMMAND_KEYS, "argv"]:
        if k in value:
            return stringified(value[k])
    return next((enveloped_command(value[k]) for k in ("args", "arguments") if k in value), "")


def command_of(event: dict) -> str:
    """The first command among the fields that may hold one."""
    for group in COMMAND_FIELDS:
        for k in group:
            if command := enveloped_command(event[k]) if k in event else "":
                return normal_command(command)
    return ""


def first_command_line(command: str, limit: int = 220) -> str:
    """What a command is shown by: its first line, or the second after a line that only sets the error mode."""
    lines = [s for line in command.splitlines() if (s := line.strip())]
    line = " ".join((lines[1] if len(lines) > 1 and _STOP.fullmatch(lines[0]) else lines[0] if lines else "").split())
    return line if len(line) <= limit else line[: limit - 1] + "…"


def without_transport(text: str) -> tuple[str, int | None]:
    """(output, exit code) of a text behind transport lines.

    With an Output: line among the first lines everything behind it is output; else the transport lines are taken out."""
    lines, code = text.splitlines(), None
    kinds = []
    for line in lines:
        s = line.strip()
        m = _EXIT.match(s)
        kinds.append("code" if m else "header" if s.startswith(HEADER_STARTS) else "output" if s == "Output:" else "")
    head = kinds[:HEADER_LINES]
    at = head.index("output") if "output" in head else None
    if at is None and not any(head):
        return text, None
    seen = range(at) if at is not None else range(len(lines))
    for k in seen:
        if kinds[k] == "code":
            code = int(_EXIT.match(lines[k].strip())[1])
    kept = lines[at + 1 :] if at is not None else [line for line, kind in zip(lines, kinds) if not kind]
    return "\n".join(kept).strip(), code


def output_of(event: dict, counts: Counter | None = None) -> tuple[str, dict]:
    """(output, metadata) of the first field that holds an output; metadata of an embedded {output, metadata} object counts first."""
    meta: dict = {}
    for k in OUTPUT_FIELDS:
        if k not in event:
            continue
        inner = embedded(event[k])
        if isinstance(inner, dict):
            if isinstance(inner.get("metadata"), dict):
                meta |= inner["metadata"]
            found = text_of(inner.get("output", inner), True, counts)
        else:
            found = text_of(event[k], True, counts)
        if found:
            body, code = without_transport(found)
            return body, meta if code is None else {"exit_code": code} | meta
    return "", meta | event["metadata"] if isinstance(event.get("metadata"), dict) else meta


def by_policy(text: str, policy: str = "full", most: int = 20_000) -> str:
    """A tool output whole (full), not at all (none), as its size and first line (summary), or its end (tail)."""
    clean = text.strip()
    if policy == "full" or not clean:
        return clean
    if policy == "none":
        return ""
    if policy == "summary":
        return f"[tool output omitted: {len(clean):,} characters; first line: {clean.splitlines()[0][:300]!r}]"
    if policy == "tail":
        return clean if len(clean) <= most else f"[TOOL OUTPUT TRUNCATED: kept final {most:,} of {len(clean):,} characters]\n\n{clean[-most:]}"
    raise ValueError(f"no output policy: {policy}")


def language_guess(text: str, fallback: str = "text") -> str:
    s = text.lstrip()
    if s[:1] in ("{", "["):
        return "json"
    if s.startswith(("diff --git", "@@ ")):
        return "diff"
    if s.startswith("import ") or "export function " in s or "const " in s:
        return "ts"
    return "ps1" if s.startswith("$ ") or any(w in s for w in ("$ErrorActionPreference", "Get-Content ", "npm run ")) else fallback


def fenced(text: str, lang: str = "", ticks: int = 3) -> str:
    body = text.rstrip()
    fence = "`" * max(ticks, 1 + max(map(len, re.findall("`+", body)), default=0))
    return f"{fence}{lang}\n{body}\n{fence}"


@dataclass
class FilePatch:
    op: str
    path: str
    lines: list[str] = field(default_factory=list)

    def signed(self, sign: str) -> list[str]:
        """Added (+) or removed (-) lines, without the headers that look like them."""
        return [x for x in self.lines if x.startswith(sign) and not x.startswith(sign * 3)]


def patch_files(command: str) -> list[FilePatch]:
    """Files of a patch, in order, each with the lines below its heading; none if the patch has no beginning or end."""
    out: list[FilePatch] = []
    if all(e in command for e in PATCH_ENDS):
        for line in command.splitlines():
            if m := _FILE.match(line):
                out.append(FilePatch(m[1].lower(), m[2].strip()))
            elif out and line.strip() not in PATCH_ENDS:
                out[-1].lines.append(line)
    return out


# Labels of file operations and fence languages of file endings.
FILE_LABELS = {"add": "Created file", "update": "Edited file", "delete": "Deleted file"}
FENCES = {
    ".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".json": "json", ".md": "md", ".css": "css",
    ".html": "html", ".yml": "yaml", ".yaml": "yaml", ".ps1": "ps1", ".py": "python", ".sh": "bash",
}


def plural(n: int, verb: str, what: str) -> str:
    return f"{verb} {n} {what}{'' if n == 1 else 's'}"


def file_card(f: FilePatch) -> str:
    """A file's operation, path, line counts and content: the lines themselves for whole files, else the difference."""
    ending = re.search(r"(?<=[^/\\])\.[^./\\]+$", f.path)
    sign = {"add": "+", "delete": "-"}.get(f.op)
    body = "\n".join(x[1:] for x in f.signed(sign)) if sign else "\n".join(f.lines)
    lang = FENCES.get(ending[0].lower() if ending else "", "text") if sign else "diff"
    head = [FILE_LABELS[f.op], f.path, f"+{len(f.signed('+'))}", f"-{len(f.signed('-'))}"]
    return "\n".join(head + ([fenced(body, lang)] if body.rstrip() else []))


def action_card(command: str, output: str, meta: dict) -> tuple[str, str, str]:
    """(text, command key, output key) of a tool action; no text if it says nothing."""
    key = command_key(command) if command else ""
    code = next((meta[k] for k in ("exit_code", "exitCode", "code") if meta.get(k) is not None), None)
    done = output.lower().startswith("success")
    if files := patch_files(command):
        ops = Counter(f.op for f in files)
        said = [plural(ops[op], FILE_LABELS[op].split()[0], "file") for op in FILE_LABELS if ops[op]]
        noise = output.lower().startswith("success. updated the following files")
        parts = [", ".join(said), *map(file_card, files), *([fenced(output, language_guess(output))] if output and not noise else []), *(["Success"] if str(code) == "0" or done else [])]
        text = "\n\n".join(parts).strip()
        return text, key, hashlib.sha256(text.encode("utf-8", "ignore")).hexdigest()
    if not command and not output:
        return "", "", ""
    parts = [f"Ran {first_command_line(command)}", fenced(f"$ {command}", "ps1")] if command else []
    parts += [fenced(output, language_guess(output))] if output else []
    parts += ["Success"] if str(code) == "0" else [f"Exit code {code}"] if code not in (None, "") else []
    return "\n\n".join(parts).strip(), key, hashlib.sha256(output.encode("utf-8", "ignore")).hexdigest() if output else ""


# ------------------------------------------------------------------------------------------------ times


def event_time(event: object) -> str:
    """The first time an event states, breadth first through its wrappers to a depth of 3; as it is written."""
    level = [event]
    for _ in range(4):
        for e in level:
            for k in TIMESTAMP_KEYS if isinstance(e, dict) else ():
                v = e.get(k)
                if isinstance(v, str) and v.strip():
                    return v.strip()
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    return str(v)
        level = [e[k] for e in level if isinstance(e, dict) for k in TIMESTAMP_WRAPPERS if isinstance(e.get(k), dict)]
    return ""


# ------------------------------------------------------------------------------------------------ user signals


def _media(kind: str, value: dict) -> str | None:
    """A marker by the hash of what identifies a medium; how it is shown does not make it another one."""
    if not ("image" in kind or "audio" in kind or any(k in value for k in ("image_url", "audio_url", "b64_json", "base64_image"))):
        return None
    what = "audio" if "audio" in kind or "audio_url" in value else "image"
    identity = {k: value[k] for k in MEDIA_IDENTITY if k in value} or value
    return f"[{what} sha256:{hashlib.sha256(json.dumps(identity, sort_keys=True, ensure_ascii=False).encode('utf-8', 'replace')).hexdigest()}]"


def signal_parts(value: object, depth: int = 0) -> Iterator[str]:
    """Texts of a prompt with markers for media, skills and mentions."""
    if isinstance(value, str):
        yield value
    elif depth <= SIGNAL_DEPTH and isinstance(value, list):
        for v in value:
            yield from signal_parts(v, depth + 1)
    elif depth <= SIGNAL_DEPTH and isinstance(value, dict):
        kind = str(value.get("type") or "").casefold()
        if marker := _media(kind, value):
            yield marker
        elif kind in ("skill", "mention"):
            yield f"[{kind}: {value.get('name') or value.get('path') or 'unspecified'}]"
        elif k := next((k for k in SIGNAL_KEYS if k in value), None):
            yield from signal_parts(value[k], depth + 1)


@dataclass
class Signal:
    text: str
    surface: str
    turn_id: str
    item_ids: list[str]


def signal_of(event: dict) -> Signal | None:
    """What a user said in an event, on which surface, under which ids; None if no user speaks."""
    payload = event.get("payload") if isinstance(event.get("payload"), dict) else {}
    item = payload.get("item") if isinstance(payload.get("item"), dict) else {}
    low = lambda d, k: str(d.get(k) or "").casefold()
    top, ptype, itype = low(event, "type"), low(payload, "type"), low(item, "type")
    surfaces = [
        (top == "event_msg" and ptype == "item_completed" and itype == "usermessage", item, "item_completed/UserMessage"),
        (ptype == "user_message", payload, "event/user_message"),
        (low(item, "role") == "user" and itype in ("message", "user_message"), item, "response_item/message"),
        (low(payload, "role") == "user", payload, "response_item/message" if top == "response_item" else "generic/user"),
        (low(event, "role") == "user", event, "generic/user"),
    ]
    origin, surface = next(((o, s) for given, o, s in surfaces if given), (None, ""))
    if origin is None:
        return None
    parts = list(signal_parts(next((origin[k] for k in ("message", "text", "content") if origin.get(k) is not None), None)))
    for k, (kind, reference) in ATTACHMENTS.items():
        for v in (origin[k] if isinstance(origin[k], list) else [origin[k]]) if origin.get(k) else ():
            body = {reference: v} if reference else v if isinstance(v, dict) else {"audio_url": v}
            parts += [p for p in signal_parts({"type": kind, **body}) if p not in parts]
    text = "\n".join(parts).strip()
    if not text:
        return None
    holders = (origin, payload, event)
    extra = origin.get("internal_chat_message_metadata_passthrough")
    turn = next((str(h["turn_id"]) for h in (*holders, extra if isinstance(extra, dict) else {}) if h.get("turn_id")), "")
    return Signal(text, surface, turn, list(dict.fromkeys(str(h[k]) for h in holders for k in ID_KEYS if h.get(k))))
