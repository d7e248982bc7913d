from datetime import datetime, timezone

import pytest

from loomlog.operators import timestamps as T

LINES = "line_id bigint, session_id string, line_no bigint, timestamp string, local_zone int, zone int, block int"
CATALOG = "session_id string, local_zone string, timestamp string"


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


def one(value, zone=None):
    early, late, change, plain = T.parse([value], [zone])
    return None if early[0] == T.NONE else int(early[0])


@pytest.mark.parametrize(
    "value, zone, want",
    [
        ("2024-02-01T16:04:05.092Z", None, us(2024, 2, 1, 16, 4, 5, micro=92000)),
        ("2024-02-01t16:04:05z", None, us(2024, 2, 1, 16, 4, 5)),
        ("  2024-02-01T06:33:52.7+00:00 ", None, us(2024, 2, 1, 6, 33, 52, micro=700000)),
        ("2024-07-06T09:44:47,718+10:00", None, us(2024, 7, 5, 23, 44, 47, micro=718000)),
        ("2024-07-06T09:47:54.442279951+10:00", None, us(2024, 7, 5, 23, 47, 54, micro=442279)),
        ("2026-02-03T07:49:50+0900", None, us(2026, 2, 2, 22, 49, 50)),
        ("2024-11-29 07:17:07-06", None, us(2024, 11, 29, 13, 17, 7)),
        ("20241126T090825Z", None, us(2024, 11, 26, 9, 8, 25)),
        ("20241126T090825", "Asia/Tokyo", us(2024, 11, 26, 0, 8, 25)),
        ("1706774722", None, 1706774722_000000),
        ("1706755801.949", None, 1706755801_949000),
        ("1736178184378", None, 1736178184_378000),
        ("1759112988416885", None, 1759112988_416885),
        ("03.02.2025 02:43:31", "UTC", us(2025, 2, 3, 2, 43, 31)),
        ("03/01/2024 08:14:28 PM", "UTC", us(2024, 3, 1, 20, 14, 28)),
        ("2026-05-04 12:42:56 UTC", None, us(2026, 5, 4, 12, 42, 56)),
        ("Thu, 01 Feb 2024 05:33:15 +0000", None, us(2024, 2, 1, 5, 33, 15)),
        ("October 7, 2024 at 12:12:02 AM CEST", None, us(2024, 10, 6, 22, 12, 2)),
        ("June 29, 2025 at 02:26:46 AM UTC+10:00", None, us(2025, 6, 28, 16, 26, 46)),
        ("May 24, 2025 at 05:14:07 PM", "America/Chicago", us(2025, 5, 24, 22, 14, 7)),
        ("2025-12-13T04:38:01-03:00[America/Sao_Paulo]", None, us(2025, 12, 13, 7, 38, 1)),
        ("2025-12-13T04:38:01[Asia/Kathmandu]", None, us(2025, 12, 12, 22, 53, 1)),
        ("2024-02-01T16:04:05." + "1" * 60 + "Z", None, us(2024, 2, 1, 16, 4, 5, micro=111111)),  # any number of digits
        ("2024-02-01T16:04:05." + "9" * 300_000 + "Z", None, us(2024, 2, 1, 16, 4, 5, micro=999999)),
        ("2160-07-01 12:00:00", "America/New_York", us(2160, 7, 1, 16)),  # rules go on for ever
        ("2160-01-01 12:00:00", "America/New_York", us(2160, 1, 1, 17)),
        ("9999-07-01 12:00:00", "Europe/Berlin", us(9999, 7, 1, 10)),
        ("2499-12-31 23:30:00", "America/New_York", us(2500, 1, 1, 4, 30)),
        ("1850-07-01 12:00:00", "America/New_York", us(1850, 7, 1, 16, 56, 2)),  # local mean time
        ("2024-02-01T16:04:05Z\0", None, None),
        ("2024-10-10 09:04:30.56", None, None),  # wall time without a zone
        ("2024-10-10 09:04:30.56", "Mars/Base", None),
        ("2024-03-10 02:30:00", "America/New_York", None),  # skipped
        ("2024-02-30T17:21:02Z", None, None),
        ("2024-06-26T25:24:32Z", None, None),
        ("2024-06-26T24:00:00Z", None, None),
        ("2024-02-01T12:17:61+00:00", None, None),
        ("2026-13-18T01:43:14", "UTC", None),
        ("0000-00-00 00:00:00", "UTC", None),
        ("13/01/2024 08:14:28 PM", "UTC", None),
        ("03/01/2024 13:14:28 PM", "UTC", None),
        ("Fri, 01 Feb 2024 05:33:15 +0000", None, None),  # another weekday
        ("12:51:49", "UTC", None),
        ("2025-06-19", "UTC", None),
        ("not recorded", "UTC", None),
        ("NaN", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("9" * 500, None, None),
        ("２０２４-02-01T00:00:00Z", None, None),
    ],
)
def test_notations(value, zone, want):
    assert one(value, zone) == want


def test_plain_form_is_exact():
    plain = lambda v: bool(T.parse([v], [None])[3][0])
    assert plain("2024-02-01T16:04:05Z") and plain("2024-02-01T16:04:05.1234567Z")
    assert not plain("2024-02-01t16:04:05Z") and not plain(" 2024-02-01T16:04:05Z") and not plain("2024-02-01 16:04:05Z")


def test_fold_follows_session_order(spark):
    rows = [
        (1, "a", 1, "2024-11-03T05:10:00Z"),
        (2, "a", 2, "2024-11-03 01:20:00"),  # 05:20Z, nothing later before it
        (3, "a", 3, "2024-11-03T06:05:00Z"),
        (4, "a", 4, "2024-11-03 01:10:00"),  # earlier instant lies before line 3: 06:10Z
        (5, "a", 5, "2024-11-03 01:40:00"),  # after line 4 too: 06:40Z
        (6, "a", 5, "2024-11-03 01:40:00"),  # redelivered
        (7, None, 1, "2024-11-03 01:40:00"),
        (8, "a", None, "2024-11-03 01:40:00"),
        (9, "a", 5000, "2024-11-03 01:50:00"),  # another block
    ]
    lines = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], LINES)
    catalog = spark.createDataFrame([("a", "America/New_York", "x"), (None, "UTC", "x"), ("b", None, "x"), ("a", None, "x")], CATALOG)
    got = {r[0]: r[1] for r in T.found(lines, catalog).collect()}
    at = lambda h, m: us(2024, 11, 3, h, m)
    assert got == {2: at(5, 20), 4: at(6, 10), 5: at(6, 40), 6: at(6, 40), 8: at(5, 40), 9: at(6, 50)}


def test_fold_against_brute_force(spark):
    import random

    rnd, rows = random.Random(5), []
    for k in range(400):
        minute = rnd.randrange(60)
        text = rnd.choice([f"2024-11-03 01:{minute:02}:00", f"2024-11-03 01:{minute:02}:00", f"2024-11-03T0{rnd.choice('56')}:{minute:02}:30Z", "junk"])
        rows.append((k, f"s{k % 40}", rnd.randrange(12), text))
    lines = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], LINES)
    catalog = spark.createDataFrame([(f"s{k}", "America/New_York", "x") for k in range(40)], CATALOG)
    got = {r["line_id"]: r["utc_us"] for r in T.normalise(lines, catalog, block_lines=3).collect()}
    want, done = {}, {}
    for i, s, n, text in sorted(rows, key=lambda r: (r[1], r[2])):
        early, late, _, _ = (int(x[0]) for x in T.parse([text], ["America/New_York"]))
        before = max((v for (s2, n2, v) in done.values() if s2 == s and n2 < n), default=T.NONE)
        v = None if early == T.NONE else late if late != T.NONE and early < before else early
        want[i] = v
        if v is not None:
            done[i] = (s, n, v)
    assert got == want


def test_empty_tables(spark):
    assert T.found(spark.createDataFrame([], LINES), spark.createDataFrame([], CATALOG)).collect() == []
