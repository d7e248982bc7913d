"""Text cut off by storage limits or in transfer.

Step 1 recomputes the length of every text under several storage measures (characters, UTF-16 units, UTF-8 bytes, with
HTML or JSON escapes, with CR LF line ends) and counts lengths by source and measure.  A limit is the greatest length
of a source under a measure if it occurs more often than the lengths just below it can explain (a bound on a Poisson tail,
so that what counts as often follows from the data and not from a fixed number).  Of the measures that agree the
one with the highest count holds.  Step 2 inspects endings: a text at its source's limit is cut unless its end is
complete; any other text is cut if it ends within a character, in an open code block, without the mark that its kind of
sentence has everywhere else, in a part of a word, or in a word whose form is elsewhere only the beginning of a longer one
(such as a path before its ending): how words are formed is counted, not given.

All of it is Catalyst expressions; what is shuffled are counts and the candidates' last words.

Defined results for odd input: null, empty and blank texts are never cut; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.storage import materialize

#: A limit's length occurs so many times as often as the WINDOW lengths below it do on average, and so often that chance
#: explains it with a probability below e ** -SPIKE_ODDS.
SPIKE_RATIO, SPIKE_ODDS, WINDOW = 8.0, 18.0, 16
#: A form of words is only a beginning if it stands alone in less than this share of the times that it goes on with a mark.
ALONE_SHARE = 0.02
#: Limits and word forms are broadcast up to so many; beyond that, and for frequent openers, rows are spread over SALTS parts.
BROADCAST_SOURCES, BROADCAST_FORMS, SALTS = 10_000, 10_000, 16
#: Openers of which at least this share of the sentences lacks a final mark are complete without one.
UNMARKED_SHARE = 0.5
#: An opener is known from so many other texts on, a word is rare up to and frequent from so many uses, all as shares of the texts.
KNOWN_SHARE, RARE_SHARE, FREQUENT_SHARE = 2e-5, 1e-5, 1 / 300
#: A last word is usual for an opener from this share of its texts on.
USUAL_SHARE = 0.02
#: A frequent word that ends texts in a smaller share of its uses ends no text.
NEVER_FINAL_SHARE = 0.005
_FINAL = r"[.?!:;…。？！」』”’\"')\]}*>|]$"
#: Words with a mark inside, such as paths and identifiers; only these have forms to compare.
_FORMED = r"[A-Za-z0-9][/_\\@#=+&|~-]+[A-Za-z0-9]"


def _count(text: str, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(F.col(text), F.lit(what), F.lit("")))) / len(what)


def measures() -> dict[str, Column]:
    """Stored length of column ``text`` under each measure; the order breaks ties."""
    chars, size = F.length("text"), F.octet_length("text")
    newlines = _count("text", "\n")
    html = _count("text", "&") * 4 + (_count("text", "<") + _count("text", ">")) * 3
    quoted = html + _count("text", '"') * 5 + _count("text", "'") * 4
    # other control characters are rare: they are counted only where there are any
    control = r"[\x00-\x07\x0b\x0e-\x1f]"
    json = F.regexp_count("text", F.lit(r'["\\\n\t\r\x08\f]')) + F.when(F.col("text").rlike(control), F.regexp_count("text", F.lit(control)) * 5).otherwise(0)
    plain = size == chars  # nothing but ASCII
    utf16 = F.when(plain, chars).otherwise(F.octet_length(F.encode("text", "UTF-16BE")) / 2)
    ascii = chars - F.length(F.regexp_replace("text", r"[\x00-\x7f]+", ""))
    escaped = F.when(plain, chars).otherwise(ascii + (utf16 - ascii) * 6)
    return {
        "characters": chars,
        "utf8_bytes": size,
        "utf16_units": utf16,
        "html_characters": chars + html,
        "html_bytes": size + html,
        "html_quoted_characters": chars + quoted,
        "html_quoted_bytes": size + quoted,
        "json_characters": chars + json,
        "json_bytes": size + json,
        "json_ascii": json + escaped,
        "crlf_characters": chars + newlines,
        "crlf_bytes": size + newlines,
    }


def form_of(word: Column) -> Column:
    """A word's form: runs of letters as a, of digits as 9, of both as a, marks as they are; without quotes and brackets around it."""
    bare = F.regexp_replace(word, r"^[\"'“‘(\[{*_`]+|[\"'”’)\]}*_`,;:!?]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\p{L}\p{M}\p{N}]*[\p{L}\p{M}][\p{L}\p{M}\p{N}]*", "a"), r"\p{N}+", "9")


def texts(lines: DataFrame, items: DataFrame) -> DataFrame:
    """table_name, record_id, source, text: one row for each text that is not blank."""
    a = lines.select(F.lit("rollout_lines").alias("table_name"), F.col("line_id").alias("record_id"), "source", F.col("payload.message").alias("text"))
    b = items.select(F.lit("response_items").alias("table_name"), F.col("item_id").alias("record_id"), "source", F.explode("payload.content.text").alias("text"))
    return a.unionByName(b).where(r"text rlike '\\S'")


def measured(rows: DataFrame) -> DataFrame:
    """Every text reduced to lengths and the facts about its end that step 2 needs; the text itself is dropped."""
    line = F.regexp_replace(F.substring_index(F.col("text"), "\n", -1), r"\s+$", "")
    unit = F.regexp_extract(line, r"^(?:.*[.?!。？！][\"'”’)\]*]*\s+|.*[。？！])?(.*)$", 1)
    fence = F.pmod(_count("text", "```"), F.lit(2)) == 1
    # what is left of a character cut in two is no part of the stored length
    rows = rows.withColumn("broken_char", F.col("text").rlike("\ufffd$"))
    rows = rows.withColumn("text", F.when(F.col("broken_char"), F.regexp_replace("text", "\ufffd+$", "")).otherwise(F.col("text")))
    return rows.select(
        "table_name",
        "record_id",
        "source",
        F.array(*(c.cast("bigint") for c in measures().values())).alias("lengths"),
        F.regexp_replace(unit, r"^(?:[-*+•>]|\d+[.)]|#+)\s+", "").alias("unit"),
        (F.expr(r"trim(BOTH ' \t\r\n' FROM text)") == unit).alias("alone"),
        line.rlike(r"^\s*(?:[-*+•]|\d+[.)])\s").alias("listed"),
        fence.alias("open_fence"),
        "broken_char",
        F.col("text").rlike(r"[^\s\n] $").alias("hanging"),
    )


def limits(measured_rows: DataFrame) -> DataFrame:
    """source, measure, limit_length, n: the hidden storage limit of each source that has one."""
    names = F.array(*(F.lit(k) for k in measures()))
    ranks = F.arrays_zip(F.sequence(F.lit(0), F.lit(len(measures()) - 1)).alias("rank"), F.col("lengths").alias("length"))
    counts = (
        measured_rows.select("source", F.inline(ranks))
        .toDF("source", "rank", "length")
        .groupBy("source", "rank", "length")
        .agg(F.count("*").alias("n"))
    )
    # the greatest length of each (source, measure), then the mean count of the lengths just below it
    top = counts.groupBy(F.col("source").alias("s"), F.col("rank").alias("r")).agg(F.max(F.struct("length", "n")).alias("top"))
    near = counts.join(top, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).select(
        "source", "rank", "length", "n", F.col("top.length").alias("limit_length"), F.col("top.n").alias("top_n")
    )
    # a multi-byte character that no longer fits leaves a byte limit up to three bytes short
    byte_like = F.get(F.array(*(F.lit(k.endswith("bytes")) for k in measures())), F.col("rank"))
    slack = F.when(byte_like, F.lit(3)).otherwise(F.lit(0))
    at = (F.col("length") >= F.col("limit_length") - slack) & (F.col("length") <= F.col("limit_length"))
    below = (F.col("length") < F.col("limit_length") - slack) & (F.col("length") >= F.col("limit_length") - slack - WINDOW)
    spikes = near.groupBy("source", "rank", "limit_length").agg(
        F.sum(F.when(at, F.col("n")).otherwise(0)).alias("n"), (F.sum(F.when(below, F.col("n")).otherwise(0)) / WINDOW).alias("usual"), F.max("top_n").alias("top_n")
    )
    # the rate of the lengths below, by the rule of succession: a window without any text does not show that there are none
    rate = (F.col("usual") * WINDOW + 1) / (WINDOW + 1)
    odds = F.col("top_n") * F.log(F.col("top_n") / rate) - (F.col("top_n") - rate)
    spikes = spikes.where((F.col("top_n") >= SPIKE_RATIO * rate) & (odds >= SPIKE_ODDS))
    best = spikes.groupBy("source").agg(F.max_by(F.struct("rank", "limit_length", "n"), F.struct("n", -F.col("rank"))).alias("b"))
    return best.select("source", F.get(names, F.col("b.rank")).alias("measure"), F.col("b.rank").alias("rank"), F.col("b.limit_length").alias("limit_length"), F.col("b.n").alias("n"))


def judged(lines: DataFrame, items: DataFrame) -> DataFrame:
    """table_name, record_id, source, reason (null: complete) of every text."""
    rows = materialize(measured(texts(lines, items)), "lengths")
    total = rows.count()
    at = materialize(limits(rows).select(F.col("source").alias("s"), "rank", "limit_length"), "limits")
    if at.count() <= BROADCAST_SOURCES:
        at, salted = F.broadcast(at), F.lit(True)
    else:  # too many sources to send: spread each over SALTS parts, as one may hold a third of all rows
        at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)) == F.col("part")
    slack = F.when(F.get(F.array(*(F.lit(k.endswith("bytes")) for k in measures())), F.col("rank")), F.lit(3)).otherwise(F.lit(0))
    joined = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & salted, "left").withColumn(
        "at_limit", F.coalesce(F.get("lengths", F.col("rank")).between(F.col("limit_length") - slack, F.col("limit_length")), F.lit(False))
    )
    facts = (
        joined.withColumn("marked", F.col("unit").rlike(_FINAL) | (F.col("unit") == "") | F.col("unit").rlike("```$|`$"))
        .withColumn("opener", F.regexp_extract("unit", r"^(\S+)", 1))
        .withColumn("last_word", F.regexp_extract("unit", r"(\S+)$", 1))
    )
    # one unmarked word after other sentences may be the beginning of a word and tells nothing about openers
    scrap = (F.col("unit") == F.col("opener")) & ~F.col("marked") & (~F.col("alone") | F.col("broken_char"))
    names = ["table_name", "record_id", "source", "unit", "alone", "listed", "open_fence", "broken_char", "hanging", "at_limit", "marked", "opener", "last_word"]
    facts = materialize(facts.select(*names, scrap.alias("scrap")), "facts")  # read by every branch below

    # how sentences with this opener end, over all texts that are not at a limit
    openers = facts.where("not at_limit and not open_fence and not scrap").groupBy("opener").agg(
        F.count_if(~F.col("marked")).alias("unmarked"), F.count("*").alias("opened")
    )
    # words that stand before others or before a final mark are whole; the last word of an unmarked text may be a part
    whole = F.when(F.col("marked"), F.col("unit")).otherwise(F.regexp_replace("unit", r"\S+$", ""))
    split = F.filter(F.split(F.regexp_replace(whole, r"[^\p{L}\p{M}]+", " "), " "), lambda p: p != "")
    pieces = facts.where("not open_fence").select(split.alias("pieces"), "marked")
    last = F.transform("pieces", lambda p, i: F.struct(p.alias("piece"), ((i == F.size("pieces") - 1) & F.col("marked")).cast("int").alias("final")))
    vocabulary = pieces.select(F.inline(last)).groupBy("piece").agg(F.count("*").alias("seen"), F.sum("final").alias("final"))
    # forms of words that others follow: how often each stands alone
    every = F.split("unit", r"\s+")
    inner = F.filter(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), lambda w: w.rlike(_FORMED))
    words = facts.where("not open_fence").where(F.col("unit").rlike(_FORMED)).select(F.explode(inner).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    forms = words.groupBy(form_of(F.col("word")).alias("form")).agg(F.sum("n").alias("stands")).where("form <> ''")
    # of each form that goes on after a full stop, how often it stands without what follows
    base = F.regexp_extract("form", r"^(.*)\.[a9]$", 1)
    goes_on = forms.where(base.rlike("[^a9.]")).groupBy(base.alias("begun")).agg(F.sum("stands").alias("goes_on"))
    partial = goes_on.join(forms, F.col("begun") == F.col("form"), "left").where(F.coalesce("stands", F.lit(0)) < ALONE_SHARE * F.col("goes_on")).where(F.col("goes_on") >= F.lit(KNOWN_SHARE) * total).select("begun")

    # letters that are a word of their own, not the end of a hash
    doubtful = facts.where("not marked and not at_limit and not open_fence and not broken_char").withColumn(
        "tail", F.regexp_extract("last_word", r"(?:^|[^\p{L}\p{M}\p{N}])([\p{L}\p{M}]+)$", 1)
    )
    # a last word that texts with this opener end in again and again is whole too
    usual = doubtful.groupBy("opener", "tail").agg(F.count("*").alias("ended"))
    anywhere = usual.groupBy(F.col("tail").alias("t")).agg(F.sum("ended").alias("ended_anywhere"))
    ends = usual.join(openers, "opener", "left").join(anywhere, F.col("tail") == F.col("t")).drop("t")
    ends = ends.join(vocabulary, F.col("tail") == F.col("piece"), "left").drop("piece")
    # openers are few and some are frequent: their rows are spread over SALTS parts
    ends = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    doubtful = doubtful.withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(ends, ["opener", "tail", "part"], "left")
    # no text vouches for itself: only what the others with this opener show counts
    own = F.when(F.col("scrap"), 0).otherwise(1)
    opened, unmarked = (F.coalesce(c, F.lit(0)) - own for c in ("opened", "unmarked"))
    natural = (opened >= max(1, KNOWN_SHARE * total)) & (unmarked >= UNMARKED_SHARE * opened)
    unusual = (F.col("ended") < USUAL_SHARE * F.col("opened")) | F.col("scrap") & ~natural
    part_of_word = (F.col("tail") != "") & (F.coalesce("seen", F.lit(0)) <= RARE_SHARE * total) & unusual
    # words such as articles, which hardly ever end anything
    unfinished = (F.col("tail") != "") & (F.col("tail") == F.col("last_word")) & (F.col("seen") >= FREQUENT_SHARE * total) & (F.col("final") + F.col("ended_anywhere") < NEVER_FINAL_SHARE * F.col("seen"))
    stub = F.col("last_word").rlike(r"[_/(\[{,=-]$")
    verdict = (
        F.when(F.col("hanging"), "sentence")
        .when(~natural | stub, F.when(part_of_word | stub, "word").otherwise("sentence"))
        .when(part_of_word, "word")
        .when(unfinished, "sentence")
    )
    judged_ends = doubtful.select("table_name", "record_id", "source", verdict.alias("reason"))
    plain = facts.where("marked or at_limit or open_fence or broken_char").withColumn("form", F.when(F.col("last_word").endswith(".") & F.col("last_word").rlike(_FORMED), F.regexp_replace(form_of(F.col("last_word")), r"\.$", "")))
    partial = materialize(partial.select(F.col("begun").alias("form"), F.lit(True).alias("begins")), "forms")
    if partial.count() <= BROADCAST_FORMS:
        plain = plain.join(F.broadcast(partial), "form", "left")
    else:  # too many forms to send: spread over SALTS parts, as one may be that of a third of all rows
        partial = partial.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        plain = plain.withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(partial, ["form", "part"], "left")
    half = F.coalesce("begins", F.lit(False))
    complete = F.col("marked") & ~half & ~F.col("unit").rlike(r"[,;:]$")
    plain = plain.select(
        "table_name",
        "record_id",
        "source",
        F.when(F.col("broken_char"), "character").when(F.col("open_fence"), "block").when(F.col("at_limit") & ~complete, "limit").when(half & F.col("marked"), "word").alias("reason"),
    )
    return judged_ends.unionByName(plain)


def found(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Records with at least one cut text."""
    return judged(lines, items).where("reason is not null").select("table_name", "record_id").distinct()


def rates(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Share of records with a cut text, and the hidden limit, of each source."""
    records = judged(lines, items).groupBy("source", "table_name", "record_id").agg(F.max(F.col("reason").isNotNull().cast("int")).alias("cut"))
    share = records.groupBy("table_name", "source").agg(F.count("*").alias("records"), F.sum("cut").alias("cut"))
    return share.withColumn("cut_share", F.col("cut") / F.col("records"))
