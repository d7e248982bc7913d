import random

from pyspark.sql import Window as W, functions as F

from loomlog.operators import sequences as Q
from loomlog.operators.running import ranked, running, running_floor

RECORDS = "session_id string, line_no bigint, kind string, role string, text string, source_type string, command_key string, output_key string"


def random_records(seed, n=400):
    rnd, rows = random.Random(seed), []
    for k in range(n):
        c = rnd.random()
        what = ("message", rnd.choice(["user", "assistant"]), rnd.choice("ab"), rnd.choice("xy"), None, None) if c < 0.4 else ("action", "tool", "Ran q", "x", rnd.choice("pqr"), None) if c < 0.7 else ("action", "tool", "o", "x", None, rnd.choice("uvw"))
        rows.append((rnd.choice(["s1", "s2", None]), k, *what))
    return rows


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out.items()


def test_running_equals_a_plain_window(spark):
    df = spark.createDataFrame(random_records(1), RECORDS).withColumn("v", F.length("text") + F.col("line_no") % 7)
    w = W.partitionBy("session_id").orderBy("line_no")
    got = running(df, ["session_id"], "line_no", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block=16)
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w))
    pick = lambda d: sorted(map(tuple, d.select("line_no", "s", "m").collect()))
    assert pick(got) == pick(want)
    back = W.partitionBy("session_id").orderBy(F.col("line_no").desc()).rowsBetween(W.unboundedPreceding, -1)
    got = running(df, ["session_id"], "line_no", {"m": ("min", F.col("v"))}, before_only=True, backwards=True, block=16)
    assert sorted(map(tuple, got.select("line_no", F.coalesce("m", F.lit(-1))).collect())) == sorted(map(tuple, df.select("line_no", F.coalesce(F.min("v").over(back), F.lit(-1))).collect()))


def test_fifo_pairing_equals_a_queue(spark):
    rows = random_records(2)
    want = []
    for s, own in by_session(rows):
        queue = []
        for r in own:
            if r[6]:
                queue.append(r)
            elif r[7]:
                if queue:
                    want.append((s, queue.pop(0)[1], r[1]))
            else:
                want += [(s, q[1], None) for q in queue]
                queue = []
        want += [(s, q[1], None) for q in queue]
    got = [tuple(r)[:3] for r in Q.paired(spark.createDataFrame(rows, RECORDS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_adjacent_repeats_equal_a_fold(spark):
    rows = random_records(3)
    want = []
    for _, own in by_session(rows):
        last = None
        for r in own:
            same = last is not None and r[2:5] == last[2:5]
            if same and not (r[3] == "user" and r[2] == "message" and r[5] == last[5]):
                continue
            want.append(r[1])
            last = r
    got = [r[1] for r in Q.without_adjacent_repeats(spark.createDataFrame(rows, RECORDS)).collect()]
    assert sorted(got) == sorted(want)


def test_recent_repeats(spark):
    rows = [("s", k, "action", "tool", "t", "x", c, None) for k, c in enumerate("aabcdefghijklmna")]
    got = sorted(r[1] for r in Q.without_recent_repeats(spark.createDataFrame(rows, RECORDS)).collect())
    assert got == [k for k in range(16) if k != 1]


def test_live_lines_equal_a_replay(spark):
    rnd, rows = random.Random(9), []
    for k in range(600):
        kind = rnd.choices(["user_message", "agent_message", "thread_rolled_back", "compacted", "other"], [5, 5, 2, 0.3, 1])[0]
        n = rnd.choice([None, 0, 1, 2, 5]) if kind == "thread_rolled_back" else None
        entries = rnd.choice([None, [], [("m", "user", [("t", "x")]), None, ("m", "user", None), ("m", "assistant", [("t", "y")]), ("m", "user", [("t", "z"), None])]]) if kind == "compacted" else None
        rows.append((k, f"s{k % 12}", k // 12, "compacted" if kind == "compacted" else "event_msg", (None if kind == "compacted" else kind, n, entries, None)))
    schema = "line_id bigint, session_id string, line_no bigint, type string, payload struct<type string, num_turns bigint, replacement_history array<struct<type string, role string, content array<struct<type string, text string>>>>, item struct<type string>>"
    want = []
    for s in range(12):
        live = []
        for _, _, n, top, (kind, turns, entries, _) in [r for r in rows if r[1] == f"s{s}"]:
            if top == "compacted" and entries:
                live = [(n, False), (None, True), (None, False), (None, True)]  # its line, then its history
            elif kind in ("user_message", "agent_message"):
                live.append((n, kind == "user_message"))
            elif kind == "thread_rolled_back" and turns and turns > 0:
                at = [i for i, x in enumerate(live) if x[1]]
                live = live[: at[-turns]] if len(at) >= turns else []
        left = sum(1 for n, u in live if n is None and u)
        compactions = {r[2] for r in rows if r[3] == "compacted"}
        want += [(f"s{s}", n, left if n in compactions and (n, False) == live[0] and rows[n * 12 + s][3] == "compacted" else None) for n, _ in live if n is not None]
    got = [tuple(r) for r in Q.live_lines(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranks_equal_a_plain_window(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), k, rnd.choice(["x", "y", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, id int, title string")
    order = [F.col("title").desc_nulls_last(), F.col("id").asc()]
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order)))
    pick = lambda d: sorted((r["id"], r["rank"]) for r in d.collect())
    assert pick(ranked(df, ["key"], order)) == pick(want)


def test_level_and_floor_equal_plain_windows(spark):
    rnd = random.Random(21)
    df = spark.createDataFrame([(rnd.choice(["a", "b", None]), k, rnd.choice([-2, -1, 0, 1, 2])) for k in range(500)], "key string, line_no bigint, v bigint")
    got = {r["line_no"]: (r["level"], r["low"]) for r in running_floor(df, ["key"], "line_no", F.col("v"), block=16).collect()}
    want = {}
    for key in ("a", "b", None):
        level, low = 0, None
        for r in sorted((r for r in df.collect() if r["key"] == key), key=lambda r: r["line_no"]):
            level += r["v"]
            want[r["line_no"]] = (level, low)
            low = level if low is None else min(low, level)
    assert got == want
