import random

import pyarrow as pa

from loomlog.operators import shredding as S

LINES = "line_id bigint, payload struct<replacement_history array<struct<type string, role string, content array<struct<type string, text string>>>>, type string>, record_id int, tree int"
ITEMS = "item_id bigint, payload struct<content array<struct<type string, text string>>>, pos_1 int"


def history(rnd):
    part = lambda: rnd.choice([None, (None, None), ("t", "x" * rnd.randrange(3))])
    entry = lambda: rnd.choice([None, ("message", rnd.choice([None, "user"]), rnd.choice([None, [part() for _ in range(rnd.randrange(4))]]))])
    return rnd.choice([None, [entry() for _ in range(rnd.randrange(4))]])


def test_round_trip_against_plain_loops(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, (history(rnd), "x")]), 0, 0) for i in range(300)]
    lines = spark.createDataFrame(rows, LINES)
    items = spark.createDataFrame([(i, rnd.choice([None, (None,), ([None, ("t", "y"), (None, None)],), ([],)]), 0) for i in range(50)], ITEMS)
    got = sorted(map(tuple, S.parts(lines, items).collect()), key=str)
    want = []
    for i, p, *_ in rows:
        for e, entry in enumerate((p and p[0]) or []):
            for k, part in enumerate((entry and entry[2]) or []):
                if part is not None:
                    want.append(("rollout_lines", i, e, k, *part))
    for r in items.collect():
        for k, part in enumerate((r.payload and r.payload.content) or []):
            if part is not None:
                want.append(("response_items", r.item_id, 0, k, *part))
    assert got == sorted(want, key=str)
    entries = sorted(map(tuple, S.entries(lines).collect()), key=str)
    assert entries == sorted(((i, e, x[0], x[1]) for i, p, *_ in rows for e, x in enumerate((p and p[0]) or []) if x is not None), key=str)


def test_levels_of_a_sliced_array():
    a = pa.array([[1], None, [], [None, 2], [3]], pa.list_(pa.int64())).slice(1, 3)
    s = S.Stripe(a, [])
    assert s.rep.tolist() == [0, 0, 0, 1] and s.positions()[1].tolist() == [0, 0, 0, 1]
    assert s.elements(1).tolist() == [3]


def test_empty_tables(spark):
    assert S.parts(spark.createDataFrame([], LINES), spark.createDataFrame([], ITEMS)).collect() == []
