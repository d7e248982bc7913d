import csv
import io

from hypothesis import given, settings, strategies as st

from loomlog.operators import error_parse as E

ID, TIME = "016f7451-9f24-7c90-977d-008bd2e7a172", "2025-06-22T23:24:20.5-07:00"


def line(text="hello", session=ID, time=TIME, kind="response_item", role="user", content="input_text", n="5"):
    return ",".join([session, time, kind, role, content, n, text])


def reason(raw, delim=","):
    return E.parse_line(raw, delim)[1]


def test_reasons():
    assert reason(line()) is None
    assert reason(line('"a ""quoted"" word, and\na line"')) is None
    assert reason(line('a "quoted" word')) == "quoting"
    assert reason(line('"open')) == "quoting"
    assert reason(line('"closed" early')) == "quoting"
    assert reason(line("two\nlines")) == "quoting"
    assert reason(line("one, two")) == "column_count"
    assert reason("") == "column_count" and reason(None, None) == "column_count"
    assert reason(line(session=ID.upper())) == "value"
    assert reason(line(time="2025-02-30T00:00:00Z")) == "value"
    assert reason(line(time="2025-02-03 00:00:00Z")) == "value"
    assert reason(line(time="2025-02-03T00:00:00.1234567Z")) == "value"
    assert reason(line(kind="item")) == "value" and reason(line(role="User")) == "value" and reason(line(content="text")) == "value"
    assert reason(line(n="1234567890")) == "value" and reason(line(n=" 5")) == "value" and reason(line(n="٣")) == "value"
    assert reason(line("  ")) == "value" and reason(line("a�b")) == "value" and reason(line("a\x07b")) == "value"
    assert reason(line("tab\tis fine")) is None
    assert reason(line('"x"') + "," * 3) == "column_count"


def test_edits_state_the_repair():
    assert E.repair(line('"open'), ",")[0] == 1
    assert E.repair(line("one, two"), ",")[0] == 1
    assert E.repair("", ",")[0] == 6
    assert E.repair(line(), ",") == (0, [])
    assert E.repair("\n\n", ",")[0] >= 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab",;\n \r', max_size=6), min_size=7, max_size=7))
def test_written_records_cost_nothing(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert E.free_parse(out.getvalue(), ",") == fields
    assert E.repair(out.getvalue(), ",")[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='a",\n', max_size=7))
def test_cost_against_brute_force(text):
    """The cheapest edits, found by trying all single and double edits on three columns."""

    def sound(t):
        f = E.free_parse(t, ",")
        return f is not None and len(f) == 3

    def edits(t):
        for i in range(len(t) + 1):
            for c in '",':
                yield t[:i] + c + t[i:]
            if i < len(t) and t[i] in '",':
                yield t[:i] + t[i + 1 :]

    best, level = 0, {text}
    while not any(map(sound, level)) and best < 3:
        level, best = {e for t in level for e in edits(t)}, best + 1
    cost = E.repair(text, ",", 3)[0]
    assert cost == best if best < 3 else cost >= 3


def applied(text, edits):
    """The text after edits kind@offset."""
    out = list(text) + [""]
    for e in reversed(edits):
        kind, at = e.split("@")
        at, c = int(at), '"' if kind.endswith("quote") else ","
        out[at] = c + out[at] if kind.startswith("insert") else out[at][:-1]
    return "".join(out)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='a",', max_size=12))
def test_edits_make_a_record(text):
    for columns in (None, 1, 3, 7):
        cost, edits = E.repair(text, ",", columns)
        assert len(edits) == cost == E.repair(text, ",", columns, trace=False)[0]
        fields = E.free_parse(applied(text, edits), ",")
        assert fields is not None and columns in (None, len(fields))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='a",\n', max_size=12))
def test_reasons_follow_the_costs(text):
    assert (E.repair(text, ",", None)[0] > 0) == (E.free_parse(text, ",") is None)
    assert E.parse_line(text, ",")[:2] == E.parse_line(text, ",", trace=False)[:2]


def test_very_long_broken_records(spark):
    assert reason("a," * 30_000 + '"') == "quoting" and reason("a," * 30_000) == "column_count"


def test_tables(spark):
    schema = "raw_id bigint, file_name string, delim string, raw_line string, reason int, text int"
    rows = [(1, "f", ",", line(), 0, 0), (2, None, None, line("a|b"), 0, 0), (3, "f", "|", line().replace(",", "|"), 0, 0), (4, "f", ",", None, 0, 0), (4, "f", ",", None, 0, 0), (5, "f", ",", line("x" * 100_000), 0, 0)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r[0] for r in E.loaded(df).collect()) == [1, 2, 3, 5]
    assert [(r[0], r[2]) for r in E.rejected(df).collect()] == [(4, "column_count"), (4, "column_count")]
    assert E.parse(spark.createDataFrame([], schema)).collect() == []
