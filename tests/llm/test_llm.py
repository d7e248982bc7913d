import random
from datetime import datetime

import pytest

from loomlog.llm import conversations as C
from loomlog.llm import language as G
from loomlog.llm import mixing as M
from loomlog.llm import packing as P
from loomlog.llm import splitting as S
from loomlog.llm import truncation as T

# ------------------------------------------------------------------ conversations

ITEMS = "item_id bigint, session_id string, source string, type string, timestamp string, payload struct<type string, role string, content array<struct<type string, text string>>>, received_at timestamp, slice int, role int"


def item(session, role, time, *texts, kind="response_item", inner="message", at=datetime(2025, 1, 1)):
    return (0, session, "cli", kind, time, (inner, role, [None if t is None else ("t", t) for t in texts] if texts != (Ellipsis,) else None), at, 0, 0)


def verdicts(spark, tmp_path, rows):
    path = str(tmp_path / "items.parquet")
    spark.createDataFrame(rows, ITEMS).write.mode("overwrite").parquet(path)
    return {r["session_id"]: r["reason"] for r in C.verdicts(C.run(spark, path)).collect()}, path


def test_conversations(spark, tmp_path):
    t = lambda n, z="Z": f"2025-01-01T{n // 60:02}:{n % 60:02}:00{z}"
    rows = [
        item("good", " Human ", t(1), "q"), item("good", "MODEL", t(2), "a"), item("good", "user", t(200), "q"), item("good", "assistant", t(300), None, "a"),
        item("good", "user", t(1), "q"), item("good", "developer", None, "x"), item("good", "user", None, "​"), item("good", "bot", t(9), Ellipsis),
        item("role", "bot?", t(1), "q"), item("role", "assistant", t(2), "a"),
        item("norole", None, t(1), "q"),
        item("time", "user", "2025-01-01 00:00:00Z", "q"), item("time", "assistant", t(2), "a"),
        item("day", "user", "2025-02-30T00:00:00Z", "q"), item("day", "assistant", t(2), "a"),
        item("starts", "assistant", t(1), "a"), item("starts", "user", t(2), "q"), item("starts", "assistant", t(3), "a"),
        item("open", "user", t(1), "q"), item("open", "assistant", t(2), "a"), item("open", "user", t(300), "q"),
        item("twice", "user", t(1), "q"), item("twice", "user", t(90), "q2"), item("twice", "assistant", t(91), "a"),
        item("blank", "user", t(1), " \n ﻿"), item("blank", "assistant", t(2), ""),
        item("none", "user", t(1), "q", kind="event_msg"), item("none", "user", t(1), "q", inner="reasoning"),
        item("offset", "user", t(61, "+01:00"), "q"), item("offset", "assistant", t(2), "a"),
        item(None, "user", t(1), "q"),
        item("null", None, None, Ellipsis, kind=None, inner=None, at=None),
    ]
    got, path = verdicts(spark, tmp_path, rows)
    assert got == {
        "good": None, "role": "unusable", "norole": "unusable", "time": "unusable", "day": "unusable", "starts": "no_prompt", "open": "no_reply",
        "twice": "no_reply", "blank": "empty", "none": "empty", "offset": None, None: "no_reply", "null": "empty",
    }
    talk = sorted((r["position"], r["role"], r["text"]) for r in C.conversations(spark, path).where("session_id = 'good'").collect())
    assert talk == [(0, "user", "q"), (1, "assistant", "a"), (2, "user", "q"), (3, "assistant", "a")]


def test_small_batches_with_late_rows(spark, tmp_path):
    """Rows spread at random over files that are read one after another: the verdicts stay those of one batch."""
    rnd, rows = random.Random(3), []
    for s in range(30):
        day = 1 + rnd.randrange(5)
        for n in range(rnd.randrange(1, 9)):
            role = ["user", "assistant"][n % 2 if rnd.random() < 0.95 else 0]
            rows.append(item(f"s{s}", role, f"2025-01-{day:02}T{n:02}:{rnd.randrange(60):02}:00Z", f"t{n}"))
    rows += rnd.choices(rows, k=20)  # redelivered
    rnd.shuffle(rows)
    path = str(tmp_path / "many.parquet")
    for k in range(5):
        spark.createDataFrame(rows[k::5], ITEMS).coalesce(1).write.mode("append").parquet(path)
    pick = lambda df: {r["session_id"]: r["reason"] for r in C.verdicts(df).collect()}
    one = pick(C.run(spark, path))
    assert len(one) == 30 and len(set(one.values())) > 1
    assert pick(C.run(spark, path, files_per_batch=1)) == one
    assert pick(C.run(spark, path, timeout="2 days")) == one


def test_rows_beyond_the_delay_are_never_lost_silently(spark, tmp_path):
    path = str(tmp_path / "late.parquet")
    for k, day in enumerate((1, 20, 21, 22, 2)):
        spark.createDataFrame([item("s", "user", f"2025-01-{day:02}T00:00:00Z", f"t{k}")], ITEMS).coalesce(1).write.mode("append").parquet(path)
        __import__("time").sleep(0.1)  # files are taken in the order of their times
    with pytest.raises(C.LateRows):
        C.run(spark, path, files_per_batch=1, delay="1 day")
    assert [r["reason"] for r in C.verdicts(C.run(spark, path, files_per_batch=1, delay="30 days")).collect()] == ["no_reply"]


def test_conversations_of_an_empty_table(spark, tmp_path):
    assert verdicts(spark, tmp_path, [])[0] == {}


# ------------------------------------------------------------------ truncation

LINES = "line_id bigint, source string, payload struct<type string, message string>, text int, lengths int"
PARTS = "item_id bigint, source string, payload struct<content array<struct<type string, text string>>>, unit int"


def test_truncation(spark):
    rnd = random.Random(1)
    words = "the reader keeps every line in order while a writer adds some more text to it".split()
    sentence = lambda: " ".join(rnd.choices(words, k=9)).capitalize() + "."
    long = lambda: " ".join(sentence() for _ in range(12))
    rows, cut = [], set()
    for k in range(1200):
        text = long() if k % 3 == 0 else sentence()
        source = ["web", "cli", None][k % 3 if k % 3 != 0 else (k // 3) % 2]
        if source == "web" and len(text) > 200:
            text = text[:200]
            if not text.endswith("."):
                cut.add(k)
        rows.append((k, source, ("m", text), 0, 0))
    more = {2000: "The reader keeps every li", 2001: "The reader keeps every line in�", 2002: "See:\n\n```\nthe rea", 2003: "The reader keeps "}
    fine = {3000: "go ahead", 3001: "It says …12 tokens truncated… here.", 3002: "", 3003: None, 3004: "   ", 3005: "Fine…", 3006: "- go ahead\n- go ahead"}
    rows += [(k, "cli", ("m", t), 0, 0) for k, t in {**more, **fine}.items()]
    rows += [(4000 + k, "cli", ("m", "go ahead"), 0, 0) for k in range(20)] + [(4100 + k, None, ("m", "rerun the reader"), 0, 0) for k in range(20)]
    lines = spark.createDataFrame(rows, LINES)
    items = spark.createDataFrame([(1, "cli", ([None, ("t", "The writer adds so")],), 0), (2, "cli", (None,), 0), (3, None, ([("t", "Done.")],), 0)], PARTS)
    got = {tuple(r) for r in T.found(lines, items).collect()}
    want = {("rollout_lines", k) for k in cut | more.keys()} | {("response_items", 1)}
    assert got == want
    rates = {(r["table_name"], r["source"]): r["cut"] for r in T.rates(lines, items).collect()}
    assert rates[("rollout_lines", "web")] == len(cut)
    assert T.found(spark.createDataFrame([], LINES), spark.createDataFrame([], PARTS)).collect() == []


def test_beginnings_of_words_do_not_vouch_for_themselves(spark):
    rnd = random.Random(2)
    words = "every reader keeps its lines in order while some writer adds more text to them".split()
    sentence = lambda: " ".join(["The", *rnd.choices(words, k=8)]) + "."
    cut = [f"{sentence()} Th" for _ in range(4)] + [f"{sentence()} Noth" for _ in range(3)] + ["- go ahead\n- cont"] * 3
    fine = [sentence() for _ in range(200)] + ["continue", "go ahead", "- go ahead\n- continue"] * 6
    none = spark.createDataFrame([], PARTS)
    for copies in (1, 10):  # the verdicts do not depend on the size of the input
        rows = [(k, "cli", ("m", t), 0, 0) for k, t in enumerate((cut + fine) * copies)]
        got = {r["record_id"]: r["reason"] for r in T.judged(spark.createDataFrame(rows, LINES), none).collect() if r["reason"]}
        assert got == {k: "word" for k, *_ in rows if k % len(cut + fine) < len(cut)}


def test_forms_of_words_are_counted(spark):
    """Paths go on after their stop everywhere, so one that ends with it was cut; other words with marks end sentences."""
    rnd = random.Random(5)
    name = lambda: "_".join(rnd.choices("core probe folder anchor ledger".split(), k=2))
    fine = [f"Please look at lib/{name()}.{rnd.choice(['py', 'sql'])} and at {name()} before noon." for _ in range(300)] + [f"The fix is in {name()}." for _ in range(40)]
    cut = ["Please look at lib/core_probe.", "Nothing depends on lib/ledger_anchor."]
    rows = [(k, "cli", ("m", t), 0, 0) for k, t in enumerate(cut + fine)]
    got = {r["record_id"]: r["reason"] for r in T.judged(spark.createDataFrame(rows, LINES), spark.createDataFrame([], PARTS)).collect() if r["reason"]}
    assert got == {0: "word", 1: "word"}


def test_spikes_follow_from_the_data(spark):
    """Five texts of one length are no limit among as many of the lengths below; six where there are none are."""
    line = lambda n: "x" * (n - 1) + "."
    even = [("a", line(n)) for n in range(80, 101) for _ in range(5)]
    alone = [("b", line(n)) for n in (20, 30, 40)] + [("b", line(100))] * 8
    rows = spark.createDataFrame([(k, s, ("m", t), 0, 0) for k, (s, t) in enumerate(even + alone)], LINES)
    found = T.limits(T.measured(T.texts(rows, spark.createDataFrame([], PARTS)))).collect()
    assert [(r["source"], r["limit_length"]) for r in found] == [("b", 100)]


# ------------------------------------------------------------------ splitting


def test_pieces_hold_their_promises():
    rnd = random.Random(4)
    for _ in range(400):
        body = "".join(rnd.choice(["a", "é", "漢", "😀", "\n", "\r\n", "word "]) for _ in range(rnd.randrange(120))).encode()
        limit, overlap = rnd.randrange(4, 40), rnd.choice([0, 0, 3, 8, 100])
        pieces = S.split(body, limit, overlap)
        if len(body) <= limit:
            assert pieces == []
            continue
        end = 0
        lines = body.split(b"\n")
        sizes = [len(x) + 1 for x in lines[:-1]] + [len(lines[-1])]
        for at, size, over, starts, ends, _ in pieces:
            assert size <= limit and at <= end < at + size and over == end - at <= min(overlap, limit // 2)
            body[at : at + size].decode()
            assert starts == (at == 0 or body[at - 1 : at] == b"\n") and ends == (at + size == len(body) or body[at + size - 1 : at + size] == b"\n")
            end = at + size
        assert end == len(body)
        assert {p[5] for p in pieces if not p[4]} == {k + 1 for k, n in enumerate(sizes) if n > limit}


def test_split_tables(spark):
    schema = "member_id bigint, body string, max_bytes int, overlap_bytes int, offset int"
    rows = [(1, "x" * 50 + "\nab\n", 20, 5, 0), (2, None, 20, 5, 0), (3, "x" * 50, None, 5, 0), (4, "short", 20, None, 0), (5, "a\nb\n" * 30, 20, None, 0), (5, "a\nb\n" * 30, 20, -1, 0)]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in S.forced_lines(df).collect()] == [(1, 1)]
    assert {r[0] for r in S.pieces(df).collect()} == {1, 5}
    assert S.pieces(spark.createDataFrame([], schema)).collect() == []


# ------------------------------------------------------------------ packing and mixing

DOCS = "doc_id bigint, text string, lang string, source string, tokens int, capacity int"
needs_tokenizer = pytest.mark.skipif(not __import__("os").path.exists(P.TOKENIZER), reason="no tokenizer file")


def docs(spark, n, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(k, rnd.choice([None, "", "word " * int(rnd.paretovariate(1.1) * 3)]) if k % 9 == 0 else "some word " * int(rnd.paretovariate(1.2) * 4), None, rnd.choice(["a", "a", "a", "b", "c", None]), 0, 0) for k in range(n)], DOCS)


@needs_tokenizer
def test_packing(spark):
    limits = spark.createDataFrame([("s", 64, 0), ("l", 500, 0), ("bad", None, 0), ("s", 60, 0)], "container_kind string, capacity_tokens int, doc_id int")
    rows = P.pack(docs(spark, 500), limits, cell=100).collect()
    for kind, capacity in (("s", 64), ("l", 500)):
        own = [r for r in rows if r["container_kind"] == kind]
        assert {r["doc_id"] for r in own} == set(range(500))
        fill, size = {}, {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            size.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(fill.values()) <= capacity
        assert all(len(v) == 1 or (sum(v) > capacity and sorted(v)[1:] == [capacity] * (len(v) - 1)) for v in size.values())
        assert sum(fill.values()) / (capacity * len(fill)) > 0.93
    assert len({(r["container_kind"], r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    assert P.pack(spark.createDataFrame([], DOCS), limits).collect() == []


@needs_tokenizer
def test_documents_that_fill_no_container_end_the_search(spark):
    """All of 60 % of the capacity: nothing is well filled, one level is enough."""
    df = spark.createDataFrame([(k, "word " * 60, None, "s", 0, 0) for k in range(300)], DOCS)
    packed, search = P.pack_with_search(df, spark.createDataFrame([("k", 100)], "container_kind string, capacity_tokens int"), cell=50)
    assert packed.select("container_id").distinct().count() == packed.count() == 300
    assert [(r["level"], r["evolved_cells"], r["containers"]) for r in search.collect()] == [(0, 0, 300)]
    assert [tuple(r) for r in P.promises(packed, df).collect()] == [("k", 300, 0, 0, 0, 0)]


def test_every_move_keeps_every_item_once():
    rnd = random.Random(2)
    sizes = [rnd.randrange(0, 60) for _ in range(80)]
    a, b = P.best_fit(sizes, 64, [], list(range(80))), P.best_fit(sizes, 64, P.best_fit(sizes, 64, [], list(range(0, 80, 3))), [i for i in range(80) if i % 3])
    least = P.least_containers(sizes, 64)
    for child in (P.crossover(sizes, 64, a, b, rnd), P.mutate(sizes, 64, a, rnd), P.evolve(sizes, 64, [], least, "x")[0]):
        assert sorted(i for g in child for i in g) == list(range(80)) and all(sum(sizes[i] for i in g) <= 64 for g in child)
        assert len(child) >= least


def test_bound_against_all_packings():
    rnd = random.Random(3)

    def fewest(sizes, rooms=()):
        if not sizes:
            return len(rooms)
        ways = [fewest(sizes[1:], tuple(sorted([*rooms[:k], r - sizes[0], *rooms[k + 1 :]]))) for k, r in enumerate(rooms) if r >= sizes[0]]
        return min([*ways, fewest(sizes[1:], tuple(sorted([*rooms, 20 - sizes[0]])))])

    for _ in range(60):
        sizes = [rnd.randrange(1, 21) for _ in range(7)]
        assert P.least_containers(sizes, 20) <= fewest(sizes) <= len(P.best_fit(sizes, 20, [], list(range(7))))


def test_evolution_finds_what_best_fit_misses():
    """Triples that fill containers exactly: largest first spoils them."""
    rnd, won = random.Random(5), 0
    for k in range(4):
        sizes = []
        for _ in range(12):
            x, y = rnd.randrange(26, 45), rnd.randrange(26, 35)
            sizes += [x, y, 100 - x - y]
        begun, least = P.best_fit(sizes, 100, [], list(range(36))), P.least_containers(sizes, 100)
        found = P.evolve(sizes, 100, [begun], least, f"seed {k}", generations=400)[0]
        assert least == 12 <= len(found) <= len(begun)
        won += len(found) < len(begun)
    assert won >= 3


def test_flight_keeps_both_totals():
    rnd = random.Random(3)
    tokens, share = [rnd.randrange(1, 900) for _ in range(500)], [0.37] * 500
    p = M.flight(tokens, share, "s")
    assert sum(p) == pytest.approx(sum(share)) and sum(t * x for t, x in zip(tokens, p)) == pytest.approx(0.37 * sum(tokens))
    assert sum(0 < x < 1 for x in p) <= M.LEFT
    landed = M.landing(tokens, p, "s")
    assert set(landed) <= {0.0, 1.0} and abs(sum(t * x for t, x in zip(tokens, landed)) - 0.37 * sum(tokens)) < 60 and abs(sum(landed) - sum(share)) < 1
    assert M.landing([], []) == [] and M.landing([5], [0.6], "x") in ([0.0], [1.0])
    assert sum(0 < x < 1 for x in M.flight([5] * 40 + [0] * 3 + [90_000], [0.5] * 44, "t")) <= M.LEFT


def test_flight_keeps_every_probability():
    """One very large document among small ones, and equal ones: how often each is drawn is its share."""
    tokens, share = [9000, 700, 30, 30, 30, 5, 4, 0], [0.3, 0.6, 0.5, 0.2, 0.8, 0.4, 0.7, 0.5]
    n, drawn = 1500, [0] * 8
    for k in range(n):
        for i, x in enumerate(M.landing(tokens, M.flight(tokens, share, f"{k}"), f"{k}")):
            drawn[i] += x
    assert all(abs(d / n - s) < 0.05 for d, s in zip(drawn, share))


@needs_tokenizer
def test_mix(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.3, 2, 0), ("c", 0.2, 3, 0), ("empty", 0.0, 1, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats int, doc_id int")
    d = docs(spark, 900, 7)
    rows = {r["source"]: r for r in M.shares(d, targets).where("source in ('a', 'b', 'c')").collect()}
    for s, want, most in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert rows[s]["actual_share"] == pytest.approx(want, abs=0.01) and rows[s]["most_copies"] <= most
    mixed = M.mix(d, targets, block=50)
    assert mixed.where("copies < 1 or copies > 3").count() == 0
    assert sorted(map(tuple, M.promises(mixed, targets).collect())) == [(s, True, 0, 0) for s in "abc"]
    assert M.mix(spark.createDataFrame([], DOCS), targets).collect() == []


# ------------------------------------------------------------------ languages

TEMPLATES = {
    "en": ["The {} reader keeps every line in order", "Why does the {} writer fail on a cold start", "We should move the {} index before the next release", "Nothing else depends on the {} filter today"],
    "de": ["Der {} Leser hält jede Zeile in ihrer Reihenfolge", "Warum bricht der {} Schreiber beim Start ab", "Wir sollten den {} Index vor der nächsten Ausgabe verschieben", "Nichts anderes hängt heute vom {} Filter ab"],
    "ru": ["Читатель {} хранит каждую строку по порядку", "Почему запись {} падает при запуске", "Ничто другое не зависит от фильтра {} сегодня"],
}


def written(rnd, lang, n):
    return " ".join(rnd.choice(TEMPLATES[lang]).format(rnd.choice(["old", "new", "big", "tx"])) + "." for _ in range(n))


def test_languages(spark):
    rnd, rows, want = random.Random(6), [], set()
    for k in range(400):
        lang = rnd.choice(list(TEMPLATES))
        other = rnd.choice([x for x in TEMPLATES if x != lang])
        text, name = written(rnd, lang, 5), lang
        if k % 20 == 0:
            name = rnd.choice([None, "unknown", "", other])
            want.add((k, lang))
        elif k % 20 == 1:
            text += "\n\n" + written(rnd, other, 2)
            want |= {(k, lang), (k, other)}
        elif k % 20 == 2:
            name = {"en": "English", "de": "deu", "ru": "ru-RU"}[lang]
            text += "\n```\ndef reader(der_leser): return 1\n```\n(Fingerspitzengefühl)"
        rows.append((k, text, name, "s", 0, 0))
    rows += [(1000, None, "en", "s", 0, 0), (1001, "", None, "s", 0, 0), (1002, "```\ncode only\n```", None, "s", 0, 0), (1003, written(rnd, "en", 3000), "en", None, 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in G.found(df).collect()} == want
    parts = G.labelled(df).collect()
    assert all(0.5 < r["confidence"] <= 1 for r in parts)
    assert G.found(spark.createDataFrame([], DOCS)).collect() == []


def test_gram_frequencies_cover_all_documents(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [written(rnd, "en", 3) for _ in range(30)] + ["Zyx wvu tsr qpo.", None, ""]
    df = spark.createDataFrame([(k, t, "en" if k < 5 else None, "s", 0, 0) for k, t in enumerate(texts)], DOCS)
    every = [s for t in texts for s in {s for _, s, n in G.sentences(t) if n >= 3}]
    want = [0] * (1 << G.BITS)
    for s in every:
        for f in set(G.grams([s])[1].tolist()):
            want[f] += 1
    given = {}
    monkeypatch.setattr(G, "train", lambda *a, **k: given.update(k))
    G.fit(G.parsed(df))
    assert given["frequencies"][1] == len(every) and given["frequencies"][0].tolist() == want


def test_held_out_accuracy_and_calibration():
    rnd = random.Random(8)
    sample = [(lang, written(rnd, lang, 1)) for lang in TEMPLATES for _ in range(200)]
    rnd.shuffle(sample)
    model = G.train([t for _, t in sample], [s for s, _ in sample])
    assert model.accuracy > 0.98 and 0.05 <= model.temperature <= 5 and model.calibration_error < 0.05
    fresh = [(lang, written(rnd, lang, 1)) for lang in TEMPLATES for _ in range(50)]
    p = model.log_probabilities([t for _, t in fresh])
    assert sum(model.labels[i] == s for i, (s, _) in zip(p.argmax(axis=1), fresh)) >= 147
    assert model.log_probabilities([]).shape == (0, 3)


def test_wrong_labels_do_not_win_over_their_sentences():
    """A tenth of the labels is wrong: neither the model nor its confidence follows them."""
    rnd = random.Random(18)
    sample = [(lang, written(rnd, lang, 1), k // 4) for k, lang in enumerate(rnd.choice(list(TEMPLATES)) for _ in range(250) for _ in range(1)) for _ in range(4)]
    sample = [(lang, written(rnd, lang, 1), d) for lang, _, d in sample]
    wrong = {d for *_, d in sample if d % 10 == 3}
    noisy = [("de" if lang == "en" else "en") if d in wrong else lang for lang, _, d in sample]
    model = G.train([t for _, t, _ in sample], noisy, [d for *_, d in sample])
    fresh = [(lang, written(rnd, lang, 1)) for lang in TEMPLATES for _ in range(60)]
    p = model.log_probabilities([t for _, t in fresh])
    right = [model.labels[i] == s for i, (s, _) in zip(p.argmax(axis=1), fresh)]
    assert sum(right) >= 178
    import numpy as np

    assert G.calibration_error(np.exp(p.max(axis=1)), np.array(right)) < 0.05


def test_labels_in_any_notation(spark):
    given = {"en": "en", " EN-gb ": "en", "pt_BR": "pt", "deu": "de", "ger": "de", "Dutch": "nl", "no": "no", "nb": "nb", "Bangla": "bn", "urd": "ur", "ta": "ta", "ms": "ms", "iw": "he",
             "Portuguese (Brazil)": "pt", "??": None, "": None, None: None, "unknown": None, "xx": None}
    df = spark.createDataFrame([(k,) for k in given], "lang string")
    assert [r[0] for r in df.select(G.label()).collect()] == list(given.values())


def test_sentences_skip_code_and_names():
    text = "**User:** Please look at src/a_b.py now. Wirklich gut gemacht!\n```\nx = 1\n```\n- `only_code`\n昨日run_itは動いていました。今日は止まります。"
    got = [s for _, s, _ in G.sentences(text)]
    assert got == ["Please look at now.", "Wirklich gut gemacht!", "昨日 は動いていました。", "今日は止まります。"]
    assert G.sentences(None) == [] and G.sentences("。。。 ...") == []
