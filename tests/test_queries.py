import glob
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from loomlog.functions import text as X
from loomlog.operators import catalog, texts, tree

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert {"session_id", "turn_no", "prompt_tokens"} <= set(df.columns) and df.count() > 0


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _value(v):
    """A value as both engines give it: floats rounded, lists as tuples."""
    return round(v, 6) if isinstance(v, float) else tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql() and not re.match(r"p\d", n)])
def test_twins_have_equal_rows(spark, duck, name):
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    pick = lambda rows, at: Counter(tuple(_value(r[k]) for k in at) for r in rows)
    assert pick(got.collect(), columns) == pick(want.fetchall(), [names.index(c) for c in columns])


def apply(spark, column, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column("t")).collect()]


def test_scalars(spark):
    assert apply(spark, X.tokens, "Hi, wörld_1!", "", None) == [4, 0, 0]
    assert apply(spark, X.lines, "a\nb", "a\n", "a\r", "", None) == [2, 1, 0, 0, 0]
    assert apply(spark, X.redacted, "token = abc; Bearer " + "x" * 20, "sk-" + "a" * 20) == ["token = [REDACTED]; Bearer [REDACTED_TOKEN]", "[REDACTED_OPENAI_KEY]"]
    assert apply(spark, X.without_controls, "\x1b]0;title\x07\x1b[31mred\x1b[0m\x00") == ["red"]
    assert apply(spark, X.mojibake_repaired, "IÆll\x92", "I\x92") == ["IÆll’", "I\x92"]
    assert apply(spark, X.truncated_tokens, "a …1,234 tokens truncated… b …6 tokens truncated…", None) == [1240, 0]
    assert apply(spark, X.slug, " A b/c!  D ", "???", None) == ["a_bc_d", "thread", "thread"]
    assert apply(spark, X.path_key, "\\\\?\\C:\\X\\", "/a/B/", None) == ["c:\\x", "\\a\\b", ""]
    assert apply(spark, X.fence, "a ``` b ````", "plain") == ["`````", "```"]
    assert apply(spark, X.without_transport_header, "Chunk ID: 1\nWall time: 2\nProcess exited with code 0\nOutput:\nx\ny") == ["x\ny"]
    assert apply(spark, X.exit_code, "Wall time: 2\nProcess exited with code -1\nOutput:\n", "x") == [-1, None]


def test_tolerant_parse():
    assert texts.tolerant_parse('{"a": "X:\\\\project"}') == ("exact", 0)
    assert texts.tolerant_parse('{"a": "X:\\project\\q"}') == ("repaired_escapes", 2)
    assert texts.tolerant_parse('{"a": "x\ty"}')[0] == "repaired_controls"
    assert texts.tolerant_parse("[1]")[0] == "not_object" and texts.tolerant_parse("{")[0] == "error" and texts.tolerant_parse(None)[0] == "blank"


def test_sort_spec_puts_nulls_last_and_keeps_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", "x"), ("c", "x"), ("d", "y")], "id string, title string")
    assert [r[0] for r in df.orderBy(*catalog.sort_columns("title:desc", "id")).collect()] == ["d", "a", "c", "b"]
    assert [r[0] for r in df.orderBy(*catalog.sort_columns("+title", "id")).collect()] == ["a", "c", "d", "b"]
    with pytest.raises(ValueError):
        catalog.sort_columns("title;drop", "id")


def test_preorder(spark):
    nodes = [("t", "a", None, 1, None), ("t", "b", "a", 2, 2), ("t", "c", "a", 3, 1), ("t", "d", "c", 4, 1), ("t", "x", "y", 5, 1), ("t", "y", "x", 6, 1), ("t", "o", "gone", 7, 1), ("t", "z", "x", 8, 0), (None, "a", None, 1, None)]
    got = {(r["tree"], r["id"]): (r["position"], r["depth"]) for r in tree.preorder(spark.createDataFrame(nodes, "tree string, id string, parent string, ordinal bigint, child_no bigint")).collect()}
    assert got == {("t", "a"): (1, 0), ("t", "c"): (2, 1), ("t", "d"): (3, 2), ("t", "b"): (4, 1), ("t", "o"): (5, 0), ("t", "x"): (6, 0), ("t", "z"): (7, 1), ("t", "y"): (8, 1), (None, "a"): (1, 0)}


def test_preorder_of_random_trees_and_a_deep_chain(spark):
    import random

    rnd, nodes, want = random.Random(4), [], {}
    for t in range(6):
        n = 40
        parent = {k: rnd.choice([None, rnd.randrange(n), rnd.randrange(max(1, k))]) for k in range(n)}
        child = {k: rnd.randrange(5) for k in range(n)}
        nodes += [(f"t{t}", str(k), None if p is None else str(p), k, child[k]) for k, p in parent.items()]
        seen = []

        def visit(k):
            if k not in seen:
                seen.append(k)
                for c in sorted((c for c in parent if parent[c] == k), key=lambda c: (child[c], c)):
                    visit(c)

        for k in [k for k in parent if parent[k] is None] + list(parent):
            visit(k)
        want |= {(f"t{t}", str(k)): i for i, k in enumerate(seen, 1)}
    nodes += [("deep", str(k), str(k - 1) if k else None, k, 0) for k in range(2000)]
    want |= {("deep", str(k)): k + 1 for k in range(2000)}
    rows = tree.preorder(spark.createDataFrame(nodes, "tree string, id string, parent string, ordinal bigint, child_no bigint")).collect()
    assert {(r["tree"], r["id"]): r["position"] for r in rows} == want
    assert max(r["depth"] for r in rows) == 1999
