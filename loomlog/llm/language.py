"""Languages of documents and of segments of mixed documents.

A sparse multinomial logistic regression on TF-IDF weighted, hashed character n-grams is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled documents.  The sample is cleaned of
repeated sentences that most of their documents label otherwise, of documents whose sentences together contradict their
label, and of sentences in another language.  The temperature is fitted on held-out documents, which a second, independent
model (naive Bayes on words) cleans, so that the calibrated model does not choose its own examination.  It is then applied to
every sentence of every document: sentences in agreement form segments, and a document has each language that makes up a
sentence.

Bounds of the training sample (everything else, the n-grams' frequencies included, covers all data): DOCUMENTS_PER_LABEL and
SENTENCES_PER_DOCUMENT.  Labels may name any ISO 639-1 language; those found are the classes.

Defined results for odd input: null, empty and sentence-less texts have no language; code, paths, names, numbers, speaker
marks and single foreign words are no sentences; labels that name no language count as missing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.storage import materialize

DOCUMENTS_PER_LABEL, SENTENCES_PER_DOCUMENT = 400, 6
BITS, ORDERS, HELD_OUT = 17, (1, 2, 3, 4), 10
#: A run of sentences counts for a language from this calibrated posterior on; its prior is the document's leading language.
SURE, PRIOR_LEADING = 0.9, 0.9

# Bibliographic three-letter codes, where they differ from the terminological ones, and withdrawn codes.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
WITHDRAWN = {"in": "id", "iw": "he", "ji": "yi"}


@lru_cache(maxsize=1)
def language_names() -> dict[str, str]:
    """Two-letter code of every ISO 639-1 language by its two- and three-letter codes and English name, as Java knows them."""
    locale = SparkSession.getActiveSession().sparkContext._jvm.java.util.Locale
    out = {}
    for code in locale.getISOLanguages():
        own, to = locale.forLanguageTag(code), WITHDRAWN.get(code, code)
        out |= {code: to, own.getISO3Language(): to, own.getDisplayLanguage(locale.ENGLISH).lower(): to}
    return out | BIBLIOGRAPHIC


def label(column: str = "lang") -> Column:
    """A label in any notation (region, case, three letters, English name) as a two-letter code; null if it names no language."""
    pairs = F.create_map(*(F.lit(x) for pair in language_names().items() for x in pair))
    return pairs[F.regexp_extract(F.lower(F.trim(F.col(column))), r"^(\p{L}+(?: \p{L}+)*)(?:[-_][a-z0-9]+)*(?: ?\(.*\))?$", 1)]


# ------------------------------------------------------------------------------------------------ sentences

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LEAD = re.compile(r"^\s*(?:>+\s*|#{1,6}\s+|[-*+•]\s+|\d{1,4}[.)]\s+|\[[ xX]\]\s+|\*\*[^*\n]{1,40}\*\*:?\s*|[A-Z][a-z]{2,12}:\s+(?=[A-Z\W]))+")
_STOP = re.compile(r"(?<=[.?!…])[\"'”’»)\]*_]*\s+|(?<=[。？！])")
_CODE = re.compile(r"`[^`]*`")
_IN_RUN = r"[A-Za-z0-9_./\\#@:=+<>{}\[\]-]"
#: Whole runs of ASCII that are paths, identifiers, numbers or abbreviations; words as such are never matched.
_NAME = re.compile(rf"(?<!{_IN_RUN})(?:{_IN_RUN}*?(?:[/\\_#@=<>{{}}\[\]\d]|[A-Za-z]\.[A-Za-z]|::){_IN_RUN}*|[A-Z]{{2,}}[.:]?(?!{_IN_RUN}))", re.A)
_ASIDE = re.compile(r"[(（]([^()（）]{0,60})[)）]|[\"“„«»”「『]([^\"“„«»”「』』]{0,40})[\"”“«»」』]")
_WORDS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_SPACE = re.compile(r"\s+")


def _weight(s: str) -> int:
    """Words of a sentence; two ideographs count as one."""
    cjk = len(_CJK.findall(s))
    return len(_WORDS.findall(_CJK.sub(" ", s))) + cjk // 2


def _aside(m: re.Match) -> str:
    inner = m.group(1) if m.group(1) is not None else m.group(2)
    return " " if _weight(inner or "") <= 5 else m.group()


def _blank(m: re.Match) -> str:
    """A blank for a name; its final marks stay."""
    run = m.group()
    return " " + run[len(run.rstrip(".:")) :]


def sentences(text: str | None) -> list[tuple[int, str, int]]:
    """(offset, cleaned sentence, words) of a text."""
    if not text:
        return []
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())  # noqa: E731  keeps offsets
    text = _FENCE.sub(blank, text)
    out, at = [], 0
    for line in text.split("\n"):
        start = m.end() if (m := _LEAD.match(line)) else 0
        while start < len(line):
            m = _STOP.search(line, start + 1)
            end = m.end() if m else len(line)
            clean = _CODE.sub(" ", _ASIDE.sub(_aside, line[start:end]))
            clean = _SPACE.sub(" ", _NAME.sub(_blank, clean)).strip()
            if n := _weight(clean):
                out.append((at + start, clean, n))
            start = end
        at += len(line) + 1
    return out


PARSED = "doc_id bigint, label string, offsets array<int>, sentences array<string>, words array<int>"


def parsed(documents: DataFrame) -> DataFrame:
    """PARSED of every document: its sentences, found once and written, as counting, fitting and judging each read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sentences(t) for t in b.column("text").to_pylist()]
            parts = [pa.array([[s[k] for s in f] for f in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *parts], names=["doc_id", "label", "offsets", "sentences", "words"])

    return materialize(documents.select("doc_id", label().alias("label"), "text").mapInArrow(run, PARSED), "sentences")


# ------------------------------------------------------------------------------------------------ features


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every character n-gram of padded, lower-cased texts; n-grams do not cross texts."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    rows, features = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)
        if n in orders:
            whole = row[:size] == row[n - 1 :]
            x = h * np.uint64(0x9E3779B97F4A7C15)
            rows.append(row[:size][whole])
            features.append((x >> np.uint64(64 - bits))[whole].astype(np.int64))
    return (np.concatenate(rows), np.concatenate(features)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    """weights: one row per hashed n-gram, IDF already multiplied in; a sentence's logits are its sum over sqrt(n)."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accuracy: float = float("nan")
    calibration_error: float = float("nan")

    def log_probabilities(self, texts: list[str], chunk: int = 100_000) -> np.ndarray:
        out, at = np.zeros((len(texts), len(self.labels)), np.float64), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < chunk:
                size += len(texts[end]) + 2
                end += 1
            row, feature = grams(texts[at:end])
            n = np.bincount(row, minlength=end - at)
            # rows come sorted within each n-gram order only
            order = np.argsort(row, kind="stable")
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            total = np.add.reduceat(self.weights[feature[order]], np.minimum(starts, max(len(feature) - 1, 0)), axis=0) if len(feature) else np.zeros((end - at, len(self.labels)))
            logits = np.where(n[:, None] > 0, total / np.sqrt(np.maximum(n, 1))[:, None], 0) + self.bias
            out[at:end] = logits / self.temperature
            at = end
        out -= out.max(axis=1, keepdims=True, initial=-np.inf) if len(out) else 0
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


class _Sparse:
    """Counts of distinct features of each text, as a CSR matrix."""

    def __init__(self, texts: list[str], chunk: int = 2000):
        parts, sizes = [], []
        for at in range(0, len(texts), chunk):
            own = texts[at : at + chunk]
            row, feature = grams(own)
            key, count = np.unique(row << BITS | feature, return_counts=True)
            parts.append(((key >> BITS) + at, key & ((1 << BITS) - 1), count))
            sizes.append(np.bincount(row, minlength=len(own)))
        join = lambda k, kind: np.concatenate([p[k].astype(kind) for p in parts]) if parts else np.zeros(0, kind)
        self.row, self.feature, self.count = join(0, np.int32), join(1, np.int32), join(2, np.float32)
        self.start = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.size = np.maximum(np.concatenate(sizes) if sizes else np.zeros(0, int), 1)


def _ftrl(x: _Sparse, value: np.ndarray, y: np.ndarray, classes: int, rows: np.ndarray, passes: int, batch: int = 128,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal, per coordinate) for multinomial logistic loss."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)

    def solve(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    draw = np.random.default_rng(7)
    for _ in range(passes):
        order = draw.permutation(rows)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            index = np.concatenate([np.arange(x.start[i], x.start[i + 1]) for i in own])
            local = np.repeat(np.arange(len(own)), x.start[own + 1] - x.start[own])
            feature, back = np.unique(x.feature[index], return_inverse=True)
            w, b = solve(z[feature], n[feature], l1, l2), solve(bz, bn, 0, 0)
            v = value[index]
            logits = np.zeros((len(own), classes)) + b
            for k in range(classes):
                logits[:, k] += np.bincount(local, v * w[back, k], minlength=len(own))
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            for k in range(classes):
                g = np.bincount(back, v * p[local, k], minlength=len(feature))
                old = n[feature, k]
                z[feature, k] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w[:, k]
                n[feature, k] = old + g * g
            g = p.sum(axis=0)
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    return solve(z, n, l1, l2), solve(bz, bn, 0, 0)


def _agreeing(texts: list[str], y: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Rows whose label is the one that most documents with this very sentence have; rows of sentences without one go."""
    _, text = np.unique(np.array(texts, dtype=object).astype(str), return_inverse=True)
    pairs = np.unique(np.stack([text, y, document]), axis=1)
    votes = np.zeros((text.max(initial=-1) + 1, y.max(initial=-1) + 1), np.int64)
    np.add.at(votes, (pairs[0], pairs[1]), 1)
    return 2 * votes[text, y] > votes.sum(axis=1)[text]


def _word_scores(texts: list[str], y: np.ndarray, rows: np.ndarray, classes: int) -> np.ndarray:
    """Log posterior of every text by naive Bayes on words (ideographs singly), counted on the given rows."""
    words = [_WORDS.findall(_CJK.sub(lambda m: f" {m.group()} ", t.lower())) for t in texts]
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
    counts = np.ones((len(number) + 1, classes)) / 10
    for i in rows:
        np.add.at(counts, (ids[i], y[i]), 1)
    like = np.log(counts / counts.sum(axis=0))
    out = np.array([like[x].sum(axis=0) for x in ids]).reshape(len(texts), classes)
    out -= out.max(axis=1, keepdims=True)
    return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def calibration_error(p: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: how far the stated confidence is from the share that is right, over equal-width bins."""
    which = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[which == k].mean() - right[which == k].mean()) * (which == k).mean() for k in range(bins) if (which == k).any()))


#: A sentence contradicts its label from this log odds on.
CONTRADICTS = 6.0


def train(texts: list[str], labels: list[str], documents: list[int] | None = None, passes: int = 3, frequencies: tuple[np.ndarray, int] | None = None) -> Model:
    """Fits on rows that repeated sentences do not contradict, then on documents whose sentences together agree with their
    label, without their sentences in other languages; calibrates on every HELD_OUT-th document.

    Whole documents are judged first: repeated sentences alone could confirm a wrong label by themselves."""
    names = sorted(set(labels))
    y = np.array([names.index(s) for s in labels])
    _, document = np.unique(np.arange(len(texts)) if documents is None else documents, return_inverse=True)
    x = _Sparse(texts)
    seen, total = frequencies or (np.bincount(x.feature, minlength=1 << BITS), len(texts))
    idf = np.log((1 + total) / (1 + seen)) + 1
    value = x.count * idf[x.feature] / np.sqrt(x.size[x.row])
    held, sound = document % HELD_OUT == 0, _agreeing(texts, y, document)
    fitted = lambda rows, n: _ftrl(x, value, y, len(names), np.flatnonzero(rows), n)
    model = lambda w, b, *more: Model(names, (w * idf[:, None]).astype(np.float32), b, *more)
    mine = np.arange(len(texts)), y

    def supported(scores: np.ndarray) -> np.ndarray:
        """Rows of documents that the scores of all their sentences give the label they have."""
        votes = np.zeros((document.max(initial=-1) + 1, len(names)))
        np.add.at(votes, document, np.maximum(scores, -5))
        return votes.argmax(axis=1)[document] == y

    first = model(*fitted(~held & sound, max(1, passes - 1))).log_probabilities(texts)
    second = model(*fitted(~held & sound & supported(first), max(1, passes - 1))).log_probabilities(texts)
    w, b = fitted(~held & sound & supported(second) & (second[mine] > np.log(0.1)), passes)
    judge = _word_scores(texts, y, np.flatnonzero(~held & sound), len(names))
    check = np.flatnonzero(held & sound & supported(judge) & (judge.max(axis=1) - judge[mine] < CONTRADICTS))
    if not len(check):
        return model(w, b)
    raw, want = model(w, b).log_probabilities([texts[i] for i in check]), y[check]

    def scaled(t: float) -> np.ndarray:
        s = raw / t
        s = s - s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    # n right answers out of n do not show that none is ever wrong: by Jeffreys' prior half an answer more is, with another label
    doubt, rows = 0.5 / (len(check) + 1), np.arange(len(check))

    def loss(t: float) -> float:
        s = scaled(t)
        others = (s.sum(axis=1) - s[rows, want]) / max(1, len(names) - 1)
        return -float((1 - doubt) * s[rows, want].mean() + doubt * others.mean())

    t = min(np.geomspace(0.05, 10, 120).tolist(), key=loss)
    right = raw.argmax(axis=1) == want
    return model(w, b, t, float(right.mean()), calibration_error(np.exp(scaled(t).max(axis=1)), right))


def training_sample(documents: DataFrame, per_label: int = DOCUMENTS_PER_LABEL, per_document: int = SENTENCES_PER_DOCUMENT) -> DataFrame:
    """doc_id, label, text: sentences of a hashed sample of PARSED with at most about per_label documents of each label."""
    known = documents.select("doc_id", "label", "sentences", "words").where("label is not null")
    counts = known.groupBy("label").agg(F.count("*").alias("n"))  # a row for each language
    picked = known.join(counts, "label").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * per_label / F.col("n"))
    own = F.filter("sentences", lambda s, i: F.get("words", i) >= 3)
    # every step-th sentence, so that they come from the whole text
    step = F.greatest(F.lit(1), F.floor(F.size("own") / per_document))
    chosen = F.slice(F.filter("own", lambda s, i: i % step == 0), 1, per_document)
    return picked.select("doc_id", "label", own.alias("own")).select("doc_id", "label", F.explode(chosen).alias("text"))


def frequencies(documents: DataFrame, chunk: int = 200_000) -> tuple[np.ndarray, int]:
    """In how many sentences of all PARSED documents each hashed n-gram occurs, and how many sentences there are.

    Counted inside each task, so at most 2 ** BITS counts of it are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            met: Counter = Counter()
            for found in b.column("sentences").to_pylist():
                met.update(found)
            texts, times = list(met), np.array(list(met.values()), np.int64)
            total, at = total + int(times.sum()), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < chunk:
                    size += len(texts[end]) + 2
                    end += 1
                row, feature = grams(texts[at:end])
                key = np.unique(row << BITS | feature)
                n += np.bincount(key & ((1 << BITS) - 1), weights=times[at:end][key >> BITS], minlength=1 << BITS).astype(np.int64)
                at = end
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *own], pa.int32()), pa.array([total, *n[own]], pa.int64())], names=["feature", "n"])

    # a sentence counts once for each document it is in
    once = documents.select(F.array_distinct(F.filter("sentences", lambda s, i: F.get("words", i) >= 3)).alias("sentences"))
    counts = once.mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out, own = np.zeros(1 << BITS, np.int64), counts["feature"] >= 0
    out[counts["feature"][own]] = counts["n"][own]
    return out, int(counts["n"][~own].sum())


def fit(documents: DataFrame) -> Model | None:
    """Model of the labels in PARSED documents; None if there are none."""
    rows = sorted(map(tuple, training_sample(documents).distinct().collect()))
    return train([r[2] for r in rows], [r[1] for r in rows], [r[0] for r in rows], frequencies=frequencies(documents)) if rows else None


# ------------------------------------------------------------------------------------------------ application

SEGMENTS = "doc_id bigint, label string, segment int, offset int, sentences int, words int, lang string, confidence double"


def judge(found: list[tuple[int, str, int]], scores: np.ndarray, labels: list[str]) -> list[tuple[int, int, int, str, float]]:
    """(offset, sentences, words, language, confidence) of a document's segments.

    Sentences of one or two words take the language around them."""
    full = [i for i, s in enumerate(found) if s[2] >= 3] or [max(range(len(found)), key=lambda i: found[i][2])]
    votes = np.zeros(len(labels))
    for i in full:
        votes += np.exp(scores[i]) * found[i][2]
    lead = int(votes.argmax())
    prior = np.full(len(labels), np.log((1 - PRIOR_LEADING) / max(1, len(labels) - 1)))
    prior[lead] = np.log(PRIOR_LEADING)
    runs: list[list[int]] = []
    for i in full:
        if runs and scores[i].argmax() == scores[runs[-1][-1]].argmax():
            runs[-1].append(i)
        else:
            runs.append([i])
    out: list[list] = []
    for run in runs:
        p = scores[run].sum(axis=0) + prior  # the sentences of a run speak for one language together
        p = np.exp(p - p.max())
        p /= p.sum()
        k = int(p.argmax())
        if p[k] < SURE:
            k = lead
        words = sum(found[i][2] for i in run)
        if out and out[-1][3] == k:
            out[-1][1] += len(run)
            out[-1][2] += words
            out[-1][4] += p[k] * words
        else:
            out.append([found[run[0]][0], len(run), words, k, p[k] * words])
    return [(o, n, w, labels[k], float(c / w)) for o, n, w, k, c in out]


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each segment of each PARSED document; no shuffle.  The model's size is fixed by BITS."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows: list[tuple] = []
            ids, names, offsets, said, words = (b.column(c).to_pylist() for c in ("doc_id", "label", "offsets", "sentences", "words"))
            found = [list(zip(*f)) for f in zip(offsets, said, words)]
            flat = [s for f in found for _, s, _ in f]
            distinct = list(dict.fromkeys(flat))  # repeated sentences are scored once
            place = {s: k for k, s in enumerate(distinct)}
            scores = m.log_probabilities(distinct)
            for i, name, f in zip(ids, names, found):
                if f:
                    own = scores[[place[s] for _, s, _ in f]]
                    rows += [(i, name, k, *r) for k, r in enumerate(judge(f, own, m.labels))]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            names_ = ["doc_id", "label", "segment", "offset", "sentences", "words", "lang", "confidence"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names_)

    return documents.select("doc_id", "label", "offsets", "sentences", "words").mapInArrow(run, SEGMENTS)


def found(documents: DataFrame) -> DataFrame:
    """doc_id, lang: languages of documents whose label is missing or wrong, and of documents in several languages."""
    rows = parsed(documents)
    if (model := fit(rows)) is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, lang string")
    parts = segments(rows, model)
    each = parts.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return each.where(case).select("doc_id", F.explode("langs").alias("lang"))


def labelled(documents: DataFrame) -> DataFrame:
    """doc_id, segment, offset, sentences, lang, confidence of all documents."""
    rows = parsed(documents)
    if (model := fit(rows)) is None:
        return documents.sparkSession.createDataFrame([], SEGMENTS).drop("label", "words")
    return segments(rows, model).drop("label", "words")
