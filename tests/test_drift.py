import json

import pytest

from loomlog.operators import drift as D

SCHEMA = "record_id bigint, stream string, file_no int, file_name string, line_no int, raw_json string, typed int, path int"


def files(spark, *contents, stream="s"):
    rows, k = [], 0
    for no, records in enumerate(contents, 1):
        for i, r in enumerate(records):
            rows.append((k, stream, no, f"f{no}", i, r if r is None or isinstance(r, str) else json.dumps(r), 0, 0))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


def base(n, **more):
    return {"session_id": f"{n:08x}-aaaa", "timestamp": f"2025-07-0{n % 9 + 1}T08:02:41Z", "type": ["response_item", "event_msg"][n % 2], "payload": {"role": ["user", "assistant"][n % 3 > 0], "status": ["completed", "failed"][n % 2]}, **more}


def test_changes(spark):
    one = [base(n) for n in range(20)]
    two = [{**{("ts" if k == "timestamp" else k): v for k, v in base(n).items()}, "flags": ["x"]} for n in range(20)]
    three = [{**r, "type": {"name": r["type"]}, "role": r["payload"].pop("role"), "flags": None} for r in json.loads(json.dumps(two))]
    got = {tuple(r) for r in D.changes(files(spark, one, two, three)).select("file_name", "change", "field_path", "new_path").collect()}
    assert got == {
        ("f2", "renamed", "timestamp", "ts"),
        ("f2", "added", "flags", ""),
        ("f3", "retyped", "type", ""),
        ("f3", "renamed", "payload.role", "role"),
        ("f3", "removed", "flags", ""),
    }


def test_removed_and_added_without_like_values_are_no_rename(spark):
    one = [base(n, version=f"1.{n}.0") for n in range(20)]
    two = [base(n, locale=["de", "en"][n % 2]) for n in range(20)]
    got = {tuple(r) for r in D.changes(files(spark, one, two)).select("change", "field_path").collect()}
    assert got == {("removed", "version"), ("added", "locale")}


def test_value_shapes_are_compared_whole(spark):
    path = "/".join("abcdefghijklm")
    one = [base(n, origin=f"{path}/{n}.log") for n in range(20)]
    two = [base(n, target=f"{path}/{n}:80?q=1") for n in range(20)]
    got = {tuple(r) for r in D.changes(files(spark, one, two)).select("change", "field_path").collect()}
    assert got == {("removed", "origin"), ("added", "target")}


def test_consistent_table_replays_rescued_values(spark):
    one = [base(n) for n in range(20)]
    two = [{**{("ts" if k == "timestamp" else k): v for k, v in base(n).items()}, "type": {"name": base(n)["type"]}, "extra": n} for n in range(20)]
    rows = {r["record_id"]: r for r in D.consistent(files(spark, one, two)).collect()}
    assert len(rows) == 40
    for n in range(20):
        for r in (rows[n], rows[20 + n]):
            assert (r["session_id"], r["timestamp"], r["type"], r["payload_role"]) == (base(n)["session_id"], base(n)["timestamp"], base(n)["type"], base(n)["payload"]["role"])
        assert rows[n]["rescued"] is None and json.loads(rows[20 + n]["rescued"]) == {"extra": str(n)}


def test_promoted_fields_are_replayed(spark):
    one = [base(n) for n in range(20)]
    two = [base(n, extra=[n, str(n), [n], {"v": n}][n % 4], on=n % 2 == 0) for n in range(20)]
    df = files(spark, one, two)
    assert {tuple(r) for r in D.changes(df).select("change", "field_path").collect()} == {("added", "extra"), ("added", "on")}
    rows = {r["record_id"]: r for r in D.consistent(df, approved={"extra": "number", "on": "boolean"}).collect()}
    assert [rows[20 + n]["extra"] for n in range(20)] == list(range(20)) and [rows[20 + n]["on"] for n in range(20)] == [n % 2 == 0 for n in range(20)]
    assert all(rows[n]["extra"] is None and rows[20 + n]["rescued"] is None for n in range(20))
    with pytest.raises(ValueError):
        D.promote(D.TARGET, {"type": "number"})


def test_fields_below_a_renamed_object_go_with_it(spark):
    one = [base(n) for n in range(20)]
    two = [{("body" if k == "payload" else k): v for k, v in base(n).items()} for n in range(20)]
    three = [{k: ({("state" if c == "status" else c): x for c, x in v.items()} if k == "body" else v) for k, v in r.items()} for r in two]
    df = files(spark, one, two, three)
    assert {tuple(r) for r in D.changes(df).select("change", "field_path", "new_path").collect()} == {("renamed", "payload", "body"), ("renamed", "body.status", "body.state")}
    rows = {r["record_id"]: r for r in D.consistent(df).collect()}
    for k in range(60):
        assert (rows[k]["payload_role"], rows[k]["payload_status"]) == (base(k % 20)["payload"]["role"], base(k % 20)["payload"]["status"]) and rows[k]["rescued"] is None


def test_what_cannot_be_cast_stays_rescued(spark):
    usage = [{"total_tokens": v} for v in ("12", "many", [1, 2], ["7"], {"a": 1, "b": 2}, {"n": 5}, {"n": None})]
    rows = {r["record_id"]: r for r in D.consistent(files(spark, [base(n, usage=u) for n, u in enumerate(usage)] + [base(9, type=["a", "b"])])).collect()}
    assert [rows[n]["usage_total_tokens"] for n in range(8)] == [12, None, None, 7, None, 5, None, None] and rows[7]["type"] is None
    left = [None if rows[n]["rescued"] is None else {k: json.loads(v) for k, v in json.loads(rows[n]["rescued"]).items()} for n in range(8)]
    path = "usage.total_tokens"
    assert left == [None, {path: "many"}, {path: [1, 2]}, None, {path + ".a": 1, path + ".b": 2}, None, {path: {"n": None}}, {"type": ["a", "b"]}]


def test_fields_renamed_into_another_object_are_replayed(spark):
    one = [base(n, meta={"host": "h"}) for n in range(20)]
    two = [{**{k: v for k, v in base(n).items() if k != "type"}, "meta": {"host": "h", "kind": base(n)["type"]}} for n in range(20)]
    two[0]["meta"]["kind"] = ["a", "b"]
    df = files(spark, one, two)
    assert [tuple(r) for r in D.changes(df).select("change", "field_path", "new_path").collect()] == [("renamed", "type", "meta.kind")]
    rows = {r["record_id"]: r for r in D.consistent(df).collect()}
    assert [rows[20 + n]["type"] for n in range(20)] == [None] + [base(n)["type"] for n in range(1, 20)]
    assert json.loads(rows[20]["rescued"]) == {"meta.host": '"h"', "meta.kind": '["a", "b"]'}
    assert json.loads(rows[21]["rescued"]) == {"meta.host": '"h"'} and json.loads(rows[1]["rescued"]) == {"meta.host": '"h"'}


def test_odd_input(spark):
    df = files(spark, [base(1), None, "", "[1]", "{broken", "x" * 100_000, {}], [base(1), base(1)])
    assert D.changes(df).collect() == []
    rows = D.consistent(df).collect()
    assert len(rows) == 9 and sum(1 for r in rows if r["rescued"] and "_corrupt" in r["rescued"]) >= 4
    empty = spark.createDataFrame([], SCHEMA)
    assert D.changes(empty).collect() == [] and D.consistent(empty).collect() == []
