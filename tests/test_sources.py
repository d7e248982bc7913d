import io
import json
import sqlite3
import zipfile

import pytest

from loomlog.functions import context as CX
from loomlog.operators import chunks
from loomlog.sinks import archives, files
from loomlog.sources import catalogs, exports, lines


def test_lines_with_byte_ranges(spark, tmp_path):
    import zstandard

    body = b'{"a":1}\r\n\n\xff bad\nlast \xc3\xa9'
    (tmp_path / "a.jsonl").write_bytes(body)
    frames = zstandard.ZstdCompressor().compress(body[:12]) + zstandard.ZstdCompressor().compress(body[12:])
    (tmp_path / "b.jsonl.zst").write_bytes(frames)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    rows = lines.read_lines(spark, str(tmp_path)).collect()
    for name in ("a.jsonl", "b.jsonl.zst"):
        own = sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: r["line_no"])
        assert [r["line_no"] for r in own] == [1, 2, 3, 4] and b"\n".join(bytes(r["raw"]) for r in own) == body
        assert all(body[r["byte_start"] : r["byte_end"]].rstrip(b"\n") == bytes(r["raw"]).rstrip(b"\n") for r in own)
    assert lines.read_lines(spark, str(tmp_path), most=2).count() == 4
    for size in (1, 3, 7, 16):
        again = sorted(map(tuple, lines.read_lines(spark, str(tmp_path / "a.jsonl"), split_bytes=size).collect()))
        assert again == sorted(map(tuple, (r for r in rows if r["path"].endswith("a.jsonl"))))
    assert lines.read_lines(spark, str(tmp_path / "none*")).collect() == []


def test_incomplete_frames_raise(spark, tmp_path):
    import zstandard

    body = b"".join(b'{"n": %d}\n' % n for n in range(5000))
    whole = zstandard.ZstdCompressor().compress(body)
    for name, data in (("half", whole[: len(whole) // 2]), ("second", whole + whole[:-1])):
        path = tmp_path / f"{name}.jsonl.zst"
        path.write_bytes(data)
        with pytest.raises(Exception, match="incomplete zstd frame"):
            lines.read_lines(spark, str(path)).collect()
    (tmp_path / "whole.jsonl.zst").write_bytes(whole + whole)
    assert lines.read_lines(spark, str(tmp_path / "whole.jsonl.zst")).count() == 10_000


def test_scratch_folders_are_shared_or_local():
    from types import SimpleNamespace

    from loomlog import storage

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, applicationId="x", master="yarn"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)


def test_databases_and_titles(spark, tmp_path):
    ids = [f"{k:08x}-0000-0000-0000-000000000000" for k in range(3)]
    con = sqlite3.connect(tmp_path / "c.sqlite")
    con.execute("CREATE TABLE threads (id TEXT, cwd TEXT, title TEXT, archived INTEGER)")
    con.executemany("INSERT INTO threads VALUES (?, ?, ?, ?)", [(ids[0], "/w", "t", 1), (ids[1], None, None, None), ("x", None, None, 0), (None, None, None, 0)])
    con.execute("CREATE TABLE names (Conversation_Id TEXT, Name TEXT)")
    con.executemany("INSERT INTO names VALUES (?, ?)", [(ids[0], "first"), (ids[2], "y" * 301), (ids[1], " n ")])
    con.execute("CREATE TABLE other (a TEXT)")
    con.commit()
    con.close()
    sqlite3.connect(tmp_path / "empty.sqlite").execute("CREATE TABLE x (a)").connection.commit()
    files = catalogs.database_files(spark, str(tmp_path / "*.sqlite"))
    rows = {r["session_id"]: r for r in catalogs.read_databases(files).collect()}
    assert set(rows) == set(ids[:2]) and rows[ids[0]]["archived"] == 1 and rows[ids[0]]["project_id"] is None
    assert {tuple(r) for r in catalogs.database_titles(files).collect()} == {(ids[0], "first"), (ids[1], "n")}
    (tmp_path / "index.jsonl").write_text("\n".join(json.dumps(x) for x in [{"id": "a", "title": "one"}, {"session_id": "a", "thread_name": "two"}, {"id": "b"}, [1]]) + "\nbroken")
    got = catalogs.latest_titles(lines.read_lines(spark, str(tmp_path / "index.jsonl"))).collect()
    assert [tuple(r) for r in got] == [("a", "two")]


def test_title_calls(spark):
    call = lambda title, **k: json.dumps({"payload": {"item": {"calls": [{"name": "set_thread_title", "arguments": json.dumps({"title": title}), **k}]}}})
    deep = json.loads(call("deep"))
    for _ in range(9):
        deep = [deep]
    rows = [("s", 1, call("one")), ("s", 3, call(" two ")), ("s", 2, call("x")), ("s", 4, "set_thread_title {"), ("t", 1, json.dumps(deep)), ("u", 1, None), ("v", 1, json.dumps({"name": "set_thread_title", "args": {"title": "v"}}))]
    got = {tuple(r) for r in catalogs.tool_titles(spark.createDataFrame(rows, "session_id string, line_no bigint, raw string")).collect()}
    assert got == {("s", "two"), ("v", "v")}
    listed = spark.createDataFrame([("# c",), (" a ",), ("",), ("b#",)], "value string")
    assert [r[0] for r in catalogs.listed_sources(listed).collect()] == ["a", "b#"]


def node(parent, *children, role=None, text=None):
    return {"parent": parent, "children": list(children), "message": {"author": {"role": role}, "content": {"parts": [text]}, "metadata": {"channel": "c"}} if role else None}


def test_exports(spark, tmp_path):
    mapping = {"root": node(None, "u"), "u": node("root", "a2", "a1", role="user", text="q"), "a1": node("u", role="assistant", text="x"), "a2": node("u", "u", role="assistant", text="y"), "lost": node("gone"), "c1": node("c2", "c2"), "c2": node("c1", "c1"), "bad": 3, "alone": node("u")}
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/conversations-001.json", json.dumps([{"id": "two", "title": "t", "mapping": {"n": node(None)}}, 5]))
        z.writestr("x/conversations-000.json", json.dumps([{"id": "one", "title": "t", "create_time": 1.5, "mapping": mapping}]))
        z.writestr("other.json", "{}")
    nodes = exports.message_nodes(spark, str(tmp_path / "e.zip")).cache()
    rows = {(r["conversation_id"], r["node_id"]): r for r in nodes.collect()}
    assert len(rows) == 9 and (rows["one", "a2"]["role"], rows["one", "a2"]["text"], rows["one", "a2"]["channel"], rows["one", "root"]["has_message"]) == ("assistant", "y", "c", False)
    order = sorted((r["conversation_id"], r["position"], r["node_id"], r["depth"]) for r in exports.ordered_nodes(nodes).collect())
    assert order == [("one", 1, "root", 0), ("one", 2, "u", 1), ("one", 3, "a2", 2), ("one", 4, "a1", 2), ("one", 5, "lost", 0), ("one", 6, "c1", 0), ("one", 7, "c2", 1), ("one", 8, "alone", 0), ("two", 1, "n", 0)]
    assert [r[0] for r in nodes.where(exports.matching(nodes, ids=["ONE"], title="^T")).select("conversation_id").distinct().collect()] == ["one"]
    for bad, problem in ((["conversations-000.json", "conversations-002.json"], ("missing", 1)), (["a/conversations-000.json", "b/conversations-000.json"], ("repeated", 0)), (["conversations.json", "conversations-000.json"], ("mixed", None)), (["x.json"], ("none", None))):
        assert [tuple(r) for r in exports.shard_problems(spark.createDataFrame([(n,) for n in bad], "name string")).collect()] == [problem]
    (tmp_path / "gap").mkdir()
    (tmp_path / "gap" / "conversations-001.json").write_text("[]")
    with pytest.raises(ValueError, match="missing 0"):
        exports.message_nodes(spark, str(tmp_path / "gap"))


def test_arrays_are_read_as_streams():
    values = [{"a": "é" * 50}, 12345, [], "x,]", None, 3.25, {"b": [1, {"c": "]"}]}]
    for text in (json.dumps(values, ensure_ascii=False), json.dumps(values, indent=2), "\ufeff" + json.dumps(values)):
        for size in (1, 2, 7, 1000):
            assert list(exports.elements(io.BytesIO(text.encode()), size)) == values
    assert list(exports.elements(io.BytesIO(b" [ ] "))) == []
    for bad in (b"{}", b"[1, 2", b"[{]", b""):
        with pytest.raises(ValueError):
            list(exports.elements(io.BytesIO(bad)))


def test_contents():
    assert exports.content_texts({"parts": ["a", {"content_type": "image_asset_pointer", "asset_pointer": "p"}, {"x": 1}, ""]}) == ["a", "[Non-text asset: type=image_asset_pointer; reference=p]", "[Structured non-text content: keys=x]"]
    assert exports.content_texts({"text": "t", "markdown": ["m"], "content": "c"}) == ["t", "m"] and exports.content_texts(None) == [] and exports.content_texts(5) == ["5"]


def test_files_are_written_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    write = lambda data, policy, path="d/a.txt": files.publish(spark.createDataFrame([(path, data)], "path string, data binary"), root, policy).first()
    assert write(b"one", "error")["outcome"] == "written" and write(b"one", "error")["outcome"] == "same"
    with pytest.raises(Exception, match="another file"):
        write(b"two", "error")
    assert write(b"two", "skip")["outcome"] == "skipped" and (tmp_path / "out/d/a.txt").read_bytes() == b"one"
    assert write(b"two", "rename")["written_path"] == "d/a-1.txt" and write(b"two", "rename")["outcome"] == "same"
    assert write(b"three", "overwrite")["outcome"] == "replaced" and (tmp_path / "out/d/a.txt").read_bytes() == b"three"
    assert sorted(p.name for p in (tmp_path / "out/d").iterdir()) == ["a-1.txt", "a.txt"]
    for bad in ("/abs", "../up"):
        with pytest.raises(Exception, match="no path"):
            write(b"x", "error", bad)


def test_archives_under_a_cap(spark, tmp_path):
    import random

    rnd = random.Random(3)
    bodies = ["", "short\n", "".join(f"line {rnd.random()}\n" for _ in range(900)), "é" * 3000, rnd.randbytes(3000).hex()]
    df = spark.createDataFrame([("s", k, f"{k}.txt", b) for k, b in enumerate(bodies)] + [(None, 9, "n", None)], "session_id string, member_id bigint, original string, body string")
    parts = archives.archives(df, 4096).collect()
    assert all(len(p["data"]) <= 4096 for p in parts) and len([p for p in parts if p["session_id"] == "s"]) > 3
    rows = [r for p in parts for r in archives.check(bytes(p["data"]))]
    assert all(r[0] is None for r in rows)
    sets = archives.archives(df, 4096, set_bytes=8000).collect()
    pieces = [r[2:4] for p in sets for r in archives.check(bytes(p["data"]))]
    assert len({p["set_no"] for p in sets if p["session_id"] == "s"}) > 1 and len(pieces) == len(set(pieces)) and {i for i, _ in pieces} == {0, 1, 2, 3, 4, 9}
    for k, body in enumerate(bodies):
        own = sorted((r[3], r[7]) for r in rows if r[2] == k)
        assert b"".join(d for _, d in own) == body.encode() and own[0][0] == 0
    good = bytes(parts[0]["data"])
    assert archives.check(b"no zip")[0][0] == "unreadable" and archives.check(archives.zipped({"a/b": b""}, []))[0][0] == "unsafe_name"
    assert {r[0] for r in archives.check(archives.zipped({"x": b"1"}, [{"member": "y", "id": 1, "offset": 0, "bytes": 1, "sha256": "", "original_bytes": 1, "original_sha256": ""}]))} == {"not_in_index", "missing_member"}
    broken = good[:40] + bytes([good[40] ^ 255]) + good[41:]
    assert archives.check(broken)[0][0] in ("bad_content", "unreadable", "wrong_hash")


def test_packing_into_parts():
    sizes = [6, 5, 5, 4, 4, 3, 3]
    assert [len(archives.first_fit_decreasing(s, 10)) for s in (sizes, [10, 1], [])] == [3, 2, 0]
    # first-fit decreasing needs three parts here, two are enough
    assert len(archives.first_fit_decreasing([4, 4, 3, 3, 3, 3], 10)) == 3
    groups, proved = archives.fewest_groups([4, 4, 3, 3, 3, 3], 10)
    assert len(groups) == 2 and proved and sorted(i for g in groups for i in g) == list(range(6))
    assert archives.fewest_groups([7] * 30, 10)[0] and archives.fewest_groups([7] * 5, 10) == ([[0], [1], [2], [3], [4]], True)
    with pytest.raises(ValueError):
        archives.first_fit_decreasing([11], 10)
    assert archives.strategy(100, 0.5, 100) == "one" and archives.strategy(150, 0.5, 100) == "try" and archives.strategy(150, 0.7, 100) == "parts"
    assert 0 < archives.probe(b"a" * 5_000_000) < 0.01 and archives.probe(b"") == 1.0


def test_chunks(spark):
    for text in ("", "a" * 100, "é" * 50, "ab\n" * 40, "x" * 30 + "\n" + "😀" * 20):
        data = text.encode()
        ranges = chunks.cut(data, 16)
        assert b"".join(data[a:b] for a, b in ranges) == data and all(b - a <= 16 and data[a:b].decode() is not None for a, b in ranges)
    df = spark.createDataFrame([(1, "é" * 5000), (2, None), (3, "")], "doc_id bigint, text string")
    pieces = chunks.parts(df, 64)
    assert chunks.reassembled(pieces).select("doc_id", "bytes", "whole").collect() == [(1, 10000, True)]
    assert chunks.reassembled(pieces.where("part_no <> 3")).first()["whole"] is False


def test_context_and_ranges(spark):
    texts = ["<environment_context>x</environment_context>\n<user_instructions>\ny</user_instructions>", "<environment_context>x</environment_context> and a question", "# AGENTS.md instructions for /w\n\n<INSTRUCTIONS>a</INSTRUCTIONS>", "<environment_context>open", "hi", None,
             "<turn_aborted>x</turn_aborted>", "<in-app-browser-context source='ambient-ui-state'>a</in-app-browser-context>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r[0] for r in df.select(CX.is_injected_context("t")).collect()] == [True, False, True, False, False, False, False, False]
    assert [r[0] for r in df.select(CX.is_service_context("t")).collect()] == [False] * 6 + [True, True]
    assert CX.row_numbers("1, 3-5", 6) == [1, 3, 4, 5]
    for bad in ("0", "4-2", "7", "x"):
        with pytest.raises(ValueError):
            CX.row_numbers(bad, 6)


def test_documents_state_their_own_counts_and_are_no_sources(tmp_path):
    from loomlog.sinks import documents

    render = lambda lines, tokens: "\n".join(["head", f"Lines: {lines}", f"Tokens: {tokens}", *["x"] * 7]) + "\n" + "more words " * (lines % 3)
    count = lambda t: (t.count("\n") + (not t.endswith("\n")), len(t.replace(":", " : ").split()))
    text = documents.with_own_counts(render, count)
    assert f"Lines: {count(text)[0]}\nTokens: {count(text)[1]}\n" in text
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("x")
    b.symlink_to(a)
    assert files.same_place(str(a), f"file://{b}") and not files.same_place(str(a), str(tmp_path / "c"))


def test_only_mounted_paths_are_opened():
    assert files.local_path("file:///a/b") == files.local_path("file:/a/b") == files.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        files.local_path("hdfs://host/a")


def test_tails():
    assert chunks.tail(b"abc", 10) == b"abc" and chunks.tail("é".encode() * 4, 3) == "é".encode()
    assert chunks.tail(b"x" * 10 + b"\n" + b"y" * 8, 10) == b"y" * 8 and chunks.tail(b"x" * 10 + b"\nab", 8) == b"xxxxx\nab"


def test_unfinished_ends_of_growing_logs():
    from loomlog.operators.texts import is_complete

    assert all(map(is_complete, (b"", b" \n", b'{"a": 1}', b'{"a": "X:\\q"}', b"[1]"))) and not any(map(is_complete, (b'{"a": ', b'{"a": "\xff"}', "{\"é".encode()[:-1])))
