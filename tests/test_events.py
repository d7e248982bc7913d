import base64
import json
import random
from collections import Counter

import pytest

from loomlog.functions import extract as E
from loomlog.operators import classify as K
from loomlog.operators import lineage as L
from loomlog.operators import postprocess as P
from loomlog.operators import turns as T


def line(event, **options):
    return K.classify_line(event if event is None or isinstance(event, str) else json.dumps(event), K.Options(**options))


def item(kind, top="response_item", ptype="item", **more):
    return {"type": top, "payload": {"type": ptype, "item": {"type": kind, **more}}}


def said(event, **options):
    r = line(event, **options)
    return r.get("kind"), r.get("role"), r.get("text")


def test_messages_of_all_shapes():
    assert said(item("UserMessage", "event_msg", "item_completed", content=[{"type": "text", "text": "hi"}])) == ("message", "user", "hi")
    assert said(item("AgentMessage", "event_msg", "item_completed", text="yes")) == ("message", "assistant", "yes")
    assert said(item("message", role="assistant", content=[{"text": "a"}, {"output_text": "b"}, {"text": "a"}])) == ("message", "assistant", "a\n\nb")
    assert said(item("message", role="tool", content="x"))[0] is None
    assert said({"type": "event_msg", "payload": {"type": "agent_message", "message": "m"}}) == ("message", "assistant", "m")
    assert said({"type": "x", "payload": {"role": "system", "content": "s"}}) == ("message", "system", "s")
    assert said({"type": "x", "role": "user", "payload": {"text": "t"}}) == ("message", "user", "t")
    assert said({"type": "event_msg", "payload": {"type": "agent_message_delta", "message": "m"}})[0] is None  # noise
    kind, role, text = said({"type": "event_msg", "payload": {"type": "user_message", "images": ["u1", "u2"]}})
    assert (kind, role) == ("message", "user") and text.count("[image sha256:") == 2


def test_reasoning_is_never_exported_raw():
    raw = {"type": "response_item", "payload": {"type": "reasoning", "content": "secret", "summary": [{"text": "short"}], "encrypted_content": "x"}}
    assert said(raw)[0] is None and line(raw)["reason"] == "reasoning_summary_opt_in_disabled"
    kind, role, text = said(raw, reasoning=True)
    assert (kind, role) == ("note", "assistant") and text.endswith("\n\nshort") and "secret" not in text
    empty = {"type": "response_item", "payload": {"type": "reasoning", "content": "secret"}}
    assert said(empty, reasoning=True)[0] is None and line(empty, reasoning=True)["reason"] == "reasoning_summary_empty"


def test_context_is_no_prompt():
    context = "<environment_context>\nx\n</environment_context>"
    assert said(item("message", role="user", content=context))[:2] == ("note", "system")
    assert said({"type": "event_msg", "payload": {"type": "user_message", "message": context}})[:2] == ("message", "user")  # explicit
    assert said({"type": "event_msg", "payload": {"type": "user_message", "message": "<turn_aborted>x</turn_aborted>"}})[:2] == ("note", "system")
    assert said(item("message", role="user", content=context + " and a question"))[:2] == ("message", "user")


def test_actions():
    call = {"type": "response_item", "payload": {"type": "function_call", "arguments": json.dumps({"cmd": ["ls", "-l"], "workdir": "/w"})}}
    r = line(call)
    assert (r["kind"], r["command_key"], r["output_key"]) == ("action", "ls -l", None) and r["text"].startswith("Ran ls\n-l"[:6])
    out = {"type": "response_item", "payload": {"type": "function_call_output", "output": json.dumps({"output": "Chunk ID: 1\nProcess exited with code 3\nOutput:\n{}", "metadata": {"exit_code": 2}})}}
    assert line(out)["text"] == "```json\n{}\n```\n\nExit code 2"  # what the metadata says counts first
    assert said({"type": "response_item", "payload": {"type": "function_call", "arguments": "{}"}})[0] is None
    assert said(call, actions=False)[0] is None
    changes = {"a.py": {"type": "update", "unified_diff": "+x"}, "b": "deleted"}
    text = said(item("FileChange", "event_msg", "item_completed", changes=changes, stdout="ok"))[2]
    assert text == "File change status: unknown\n\nFile: a.py\n\nChange type: update\n\nunified_diff:\n+x\n\nFile: b\n\ndeleted\n\nstdout:\nok"
    assert said(item("McpToolCall", "event_msg", "item_completed", tool="t"))[2].startswith("MCP tool item\n\n{")
    assert said(item("Extension", "event_msg", "item_completed", q=1))[:2] == ("action", "tool")
    assert said(item("ImageView", "event_msg", "item_completed", path="/p.png"))[:2] == ("note", "tool")


def test_commands():
    assert E.command_of({"input": {"args": {"argv": ["a", "b"]}}}) == "a\nb"
    assert E.command_of({"arguments": "{}", "command": "x"}) == "x"
    assert E.command_of({"arguments": '["git", "log"]'}) == "git log"
    assert E.command_key('"C:\\Program Files\\pwsh.exe" -Command "Get-Item  X\r\n Y"') == "get-item x y"
    assert E.first_command_line("$ErrorActionPreference = 'Stop'\nGo  now\nmore") == "Go now"
    assert E.first_command_line("x" * 300) == "x" * 219 + "…" and E.first_command_line(" \n") == ""


def test_patches():
    patch = "*** Begin Patch\n*** Add File: a/b.py\n+x\n+++ y\n*** Update File: c.txt\n@@\n-old\n+new\n same\n*** Delete File: d\n-gone\n*** End Patch"
    files = E.patch_files(patch)
    assert [(f.op, f.path, len(f.signed("+")), len(f.signed("-"))) for f in files] == [("add", "a/b.py", 1, 0), ("update", "c.txt", 1, 1), ("delete", "d", 0, 1)]
    text, key, out = E.action_card(patch, "Success. Updated the following files: a", {})
    assert text.startswith("Created 1 file, Edited 1 file, Deleted 1 file\n\nCreated file\na/b.py\n+1\n-0\n```python\nx\n```\n\nEdited file\nc.txt") and text.endswith("Success")
    assert key.startswith("*** begin patch") and len(out) == 64
    assert E.patch_files(patch.replace("*** End Patch", "")) == []


def test_outputs():
    assert E.without_transport("Wall time: 1\nChunk ID: x\nfree\nProcess exited with code -2\n body") == ("free\n body", -2)
    assert E.without_transport("plain\nOutput:\nbody") == ("body", None) and E.without_transport("plain") == ("plain", None)
    assert E.without_transport("\n" * 9 + "Wall time: 1")[0] == "\n" * 9 + "Wall time: 1"  # behind the first lines it is text
    assert E.by_policy(" x ", "none") == "" and E.by_policy("a\nb", "summary") == "[tool output omitted: 3 characters; first line: 'a']"
    assert E.by_policy("abcdef", "tail", 3).endswith("kept final 3 of 6 characters]\n\ndef")
    with pytest.raises(ValueError):
        E.by_policy("x", "half")
    assert [E.language_guess(t) for t in ("", " {", "diff --git a", "const x", "$ ls", "hi")] == ["text", "json", "diff", "ts", "ps1", "text"]
    assert E.fenced("a ```` b", "x") == "`````x\na ```` b\n`````"


def test_cleaning():
    counts = Counter()
    text = "\x1b]0;t\x07\x1b[31mred\x1b[0m\x00\n0;npm run\nend\r\nlast  "
    assert E.cleaned(text, counts) == "red\nend\nlast" and counts["osc_sequence"] == 1 and counts["ansi_sequence"] == 2 and counts["terminal_title_residue"] == 1
    blob = base64.b64encode(random.Random(1).randbytes(3000)).decode()
    assert E.cleaned(f"see {blob} end") == f"see {E.blob_summary('base64 blob', blob)} end"
    assert E.blob_summary("hex blob", "ab") == "[hex blob omitted: 2 characters, ~2 bytes, sha256-prefix=" + E.sha16("ab") + "]"
    assert E.cleaned(f"![alt](data:image/png;base64,{blob})") == "![alt]([base64 image omitted])"
    assert E.cleaned(f'<img src="data:image/png;base64,{blob}">') == '<img src="[base64 image omitted]">'
    assert "data:audio base64 payload omitted" in E.cleaned(f"data:audio/mp3;base64,{blob}")
    assert "hex blob omitted" in E.cleaned("key=" + "0a" * 2048)
    assert E.cleaned("x" * 512 + " plain") == "x" * 512 + " plain"
    long = E.cleaned("y " * 15_000)
    assert long.startswith("y " * 599 + "y\n[single overlong line truncated: 30,000 characters") and long.endswith("]\n" + "y " * 599 + "y")
    runs = E.cleaned("\n".join(["a"] * 40 + ["b"] + ["a"] * 3)).split("\n")
    assert runs == ["a"] * 25 + ["[repeated identical line omitted after 25 repeats]", "b"] + ["a"] * 3
    assert E.annotated("…1,234 tokens truncated…") == "[SOURCE TOOL OUTPUT TRUNCATED: 1,234 tokens omitted; not recoverable from this record]"
    with pytest.raises(ValueError):
        E.annotated("…1 tokens truncated…", "error")
    assert E.cleaned(None) == "" and E.cleaned("") == ""


def test_texts_of_nested_values():
    assert E.text_of({"result": {"output": ["x", 5, True, None]}, "text": "t"}) == "t\n\nx\n\n5\n\nTrue"
    assert E.text_of({"data": {"event": {"summary": "deep"}}}) == "deep"
    assert E.text_of('{"text": "inner"}', json_aware=True) == "inner" and E.text_of('{"text": "inner"}') == '{"text": "inner"}'
    assert E.text_of({"type": "input_image", "mime": "image/png", "url": "data:x"}) == "[image/png content part omitted: embedded base64 image/data URI]"
    assert E.text_of({"image_url": {"url": "http://x"}, "detail": "low"}) == "[image content part omitted: url/reference present, detail=low]"
    deep = "leaf"
    for _ in range(20):
        deep = [deep]
    assert E.text_of(deep) == ""
    assert E.stringified({"a": [1]}) == '{\n  "a": [\n    1\n  ]\n}' and E.stringified(["a", None, "b"]) == "a\nb"


def test_times():
    assert E.event_time({"payload": {"item": {"created_at": " t "}}, "message": {"time": 0}}) == "0"
    assert E.event_time({"payload": {"item": {"created_at": " t "}}}) == "t"
    assert E.event_time({"timestamp": "", "payload": {"timestamp": 1.5}}) == "1.5" and E.event_time({"timestamp": True}) == ""


def test_odd_lines():
    assert line(None)["status"] == line("  ")["status"] == "blank"
    assert line("[1]")["status"] == line("{")["status"] == "error" and len(line("{")["raw_sha256"]) == 64
    assert line({"type": 5, "payload": [1]})["event"] == "5/-/-" and line({})["reason"] == "unrecognized_schema"
    assert line('{"type": "event_msg", "payload": {"type": "user_message", "message": "C:\\project"}}')["repairs"] == 1


LINES = "session_id string, line_no bigint, raw string, text int"


def index(spark, *events):
    df = spark.createDataFrame([("s", k, json.dumps(e), 0) for k, e in enumerate(events, 1)], LINES)
    return [(r["turn_no"], r["line_no"], r["turn_id"], r["duplicate_lines"]) for r in T.turn_index(K.classify(df)).orderBy("turn_no").collect()]


def prompt(text, top="event_msg", **more):
    return {"type": top, "payload": {"type": "user_message", "message": text, **more}}


def surface(text, **more):
    return {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}], **more}}


ANSWER = {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}


def test_turn_identity(spark):
    assert index(spark, prompt("q"), surface("q"), ANSWER, prompt("q")) == [(1, 1, "", [2]), (2, 4, "", [])]
    assert index(spark, prompt("q"), prompt("q")) == [(1, 1, "", []), (2, 2, "", [])]  # one surface: said twice
    assert index(spark, prompt("q"), ANSWER, surface("q")) == [(1, 1, "", []), (2, 3, "", [])]
    assert index(spark, prompt("q", id="i"), ANSWER, surface("q", id="i")) == [(1, 1, "", [3])]
    assert index(spark, prompt("q", id="i"), ANSWER, surface("other", id="i")) == [(1, 1, "", []), (2, 3, "", [])]
    assert index(spark, prompt("q", turn_id="t1"), surface("q", turn_id="t2")) == [(1, 1, "t1", []), (2, 2, "t2", [])]
    assert index(spark, surface("<environment_context>x</environment_context>"), prompt("q")) == [(1, 2, "", [])]


def test_announced_turn_ids(spark):
    context = lambda t: {"type": "turn_context", "payload": {"turn_id": t}}
    started = {"type": "event_msg", "payload": {"type": "task_started", "turn_id": "t9"}}
    assert index(spark, context("t1"), prompt("a"), ANSWER, prompt("b")) == [(1, 2, "t1", []), (2, 4, "", [])]
    assert index(spark, prompt("a"), context("t1"), ANSWER, prompt("b")) == [(1, 1, "t1", []), (2, 4, "", [])]
    assert index(spark, context("t1"), ANSWER, prompt("a")) == [(1, 3, "", [])]  # activity ends the announcement
    assert index(spark, started, prompt("a"), prompt("b", turn_id="x")) == [(1, 2, "t9", []), (2, 3, "x", [])]


def test_post_processing_equals_plain_lists(spark):
    rnd, rows = random.Random(7), []
    for k in range(500):
        c = rnd.random()
        if c < 0.2:
            rows.append((f"s{k % 3}", k, "message", "user", "hello", None, None))
        elif c < 0.55:
            key = rnd.choice("abcdefghijklmnop")
            rows.append((f"s{k % 3}", k, "action", "tool", f"Ran {key}", key, None))
        elif c < 0.9:
            key = rnd.choice("uvwxyz")
            rows.append((f"s{k % 3}", k, "action", "tool", f"out {key}" + ("\n\nCreated file" if key == "u" else ""), None, key))
        else:
            rows.append((f"s{k % 3}", k, "action", "tool", rnd.choice(["Action `tool`", "both\nEdited file", P.PATCH_ECHO]), rnd.choice([None, "p"]), rnd.choice([None, "q"])))
    schema = "session_id string, line_no bigint, kind string, role string, text string, command_key string, output_key string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as source_type", "'t' as timestamp")
    want = []
    for s in ("s0", "s1", "s2"):
        kept, commands, outputs = [], [], []
        for r in [r for r in rows if r[0] == s]:
            act, text, c, o = r[2] == "action", r[4], r[5], r[6]
            if act and c:
                if c in commands[-12:] and not o:
                    continue
                commands.append(c)
            if act and o:
                if o in outputs[-3:]:
                    continue
                outputs.append(o)
            if act and (text in P.NOISE_CARDS or not c and P.PATCH_ECHO in text):
                continue
            kept.append([r[1:2], act, text, c, o])
        joined, queue = [], []
        for r in kept:
            lines, act, text, c, o = r
            if act and c and not o:
                queue.append(r)
            elif act and o and not c and queue:
                q = queue.pop(0)
                joined.append([q[0] + lines, True, q[2] + "\n\n" + text, q[3], o])
            else:
                joined, queue = joined + queue + [r], []
        joined += queue
        k, out = 0, []
        while k < len(joined):
            end = k
            while end < len(joined) and joined[end][1]:
                end += 1
            if end > k:
                block = joined[k:end]
                n = [sum(b[2].split("\n").count(f"{v} file") for b in block) for v in ("Created", "Edited", "Deleted")]
                text = P.block_summary(*n, sum(1 for b in block if b[3] or b[2].startswith("Ran ")))
                out += [(tuple(sorted(x for b in block for x in b[0])), text)] * bool(text) + [(tuple(b[0]), b[2]) for b in block]
            else:
                out.append((tuple(joined[k][0]), joined[k][2]))
                end = k + 1
            k = end
        want += [(s, i, *x) for i, x in enumerate(out, 1)]
    got = [(r["session_id"], r["position"], tuple(r["source_lines"]), r["text"]) for r in P.post_processed(df).collect()]
    assert sorted(got) == sorted(want)


def test_ranges(spark):
    schema = "session_id string, line_start bigint, line_end bigint, byte_start bigint, byte_end bigint, kind string"
    rows = [("s", 1, 2, 0, 20, "selected"), ("s", 3, 3, 20, 25, "selected"), ("s", 2, 2, 10, 20, "context"), ("s", 5, 5, 40, 50, "context"), ("s", 4, 4, 25, 40, "context"), (None, 1, 1, 0, 5, "selected")]
    got = {tuple(r) for r in L.merged(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 1, 1, 0, 5, "selected"), ("s", 1, 3, 0, 25, "selected"), ("s", 4, 5, 25, 50, "context")}
    with pytest.raises(Exception, match="overlap"):
        L.merged(spark.createDataFrame([("s", 1, 2, 0, 20, "selected"), ("s", 2, 3, 10, 30, "selected")], schema)).collect()
    lines = spark.createDataFrame([("s", 1, 0, 5)], "session_id string, line_no bigint, byte_start bigint, byte_end bigint")
    for bad in (-1, 7):
        with pytest.raises(Exception, match="line"):
            L.line_ranges(lines, spark.createDataFrame([("s", [1, bad])], "session_id string, source_lines array<bigint>")).collect()


def test_strict_parsing_skips_nothing(spark):
    df = spark.createDataFrame([("s", 1, "{", 0)], LINES)
    with pytest.raises(Exception, match="cannot be parsed"):
        K.strict(K.classify(df)).collect()


def test_empty_tables(spark):
    empty = K.classify(spark.createDataFrame([], LINES))
    assert T.turn_index(empty).collect() == [] and P.post_processed(empty).collect() == []
