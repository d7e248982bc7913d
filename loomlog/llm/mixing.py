"""Mixing sources to target shares of all tokens by cube-method balanced sampling.

The largest total is taken at which no source needs more than its allowed repeats.  Every document of a source then has
the same expected number of copies: a whole part, used as is, and a fraction, drawn by the cube method.  The flight
takes a hand of documents, largest first, and moves their fractions along the null space of both constraints (tokens,
documents) until one of them is 0 or 1, so both totals stay as expected.  It runs in hashed blocks, each of which leaves
at most LEFT documents; those are flown again together until one block is left.  The landing decides the last ones by
dropping one constraint at a time: tokens first, then documents, so every document keeps its probability.  As large
documents are decided first, the landing meets the smallest ones.

Defined results for odd input: documents without a source or of a source without a target are left out; sources whose
documents have no tokens cannot take part and their share is not reached; null texts count 0 tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomlog.llm.tokens import TOKENIZER, with_tokens
from loomlog.storage import materialize

#: Documents of a block; documents that a block leaves to the next level; documents that move together.
BLOCK, LEFT, HAND = 2000, 2, 64
MOST_TASKS = 10_000
FLOWN = "source string, doc_id bigint, tokens bigint, expected double, whole int, open double"
EPS, LEAST_ROOM = 1e-9, 0.02


def _direction(tokens: np.ndarray, room: np.ndarray, balanced: bool) -> np.ndarray:
    """A move of the first document, with what the others have to give for it; zero if it cannot move.

    The unit vector is projected on the moves that keep the sum (and, balanced, the tokens).  Documents are weighed by
    the room they have, so that one near 0 or 1 gives little and does not end the step at once."""
    if balanced and len(tokens) == 3 and np.ptp(tokens):
        return np.array([tokens[1] - tokens[2], tokens[2] - tokens[0], tokens[0] - tokens[1]])
    w = np.maximum(room, LEAST_ROOM)
    rows = [np.ones(len(tokens))]
    if balanced and np.ptp(tokens):
        rows.append((tokens - (w @ tokens) / w.sum()) / np.ptp(tokens))
    v = np.zeros(len(tokens))
    v[0] = w[0]
    for _ in range(2):  # the second pass takes away what rounding left
        for r in rows:
            v -= w * r * (r @ v) / (w @ (r * r))
    return v


def _moved(p: np.ndarray, v: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """p after one step of a martingale along v: to one of both ends, drawn so that every expected share stays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(v > 0, (1 - p) / v, np.where(v < 0, p / -v, np.inf)).min()
        down = np.where(v > 0, p / v, np.where(v < 0, (1 - p) / -v, np.inf)).min()
    p = p + (up if draw.random() * (up + down) < down else -down) * v
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def flight(tokens: list[int], share: list[float], seed: str = "", leave: int = LEFT, balanced: bool = True) -> list[float]:
    """Moves shares until at most leave (2 or more; 1 or more if not balanced) are left between 0 and 1.

    Their sum stays and, balanced, the sum of tokens times share too."""
    draw = np.random.default_rng(list(seed.encode()))
    size, p = np.array(tokens, float), np.array(share, float)
    waiting = [i for i in np.argsort(-size, kind="stable") if EPS < p[i] < 1 - EPS][::-1]  # the largest comes last, and first out
    hand: list[int] = []
    while True:
        while len(hand) < HAND and waiting:
            hand.append(waiting.pop())
        if len(hand) + len(waiting) <= leave:
            return p.tolist()
        for lead in range(len(hand)):  # the largest that can move at all
            own = np.array([hand[lead], *hand[:lead], *hand[lead + 1 :]])
            v = _direction(size[own], np.minimum(p[own], 1 - p[own]), balanced)
            if abs(v[0]) > 1e-7 * np.abs(v).max() > 0:
                break
        else:
            raise AssertionError("three documents can always move")
        v[np.abs(v) < 1e-9 * np.abs(v).max()] = 0
        p[own] = _moved(p[own], v, draw)
        hand = [i for i in hand if 0 < p[i] < 1]


def landing(tokens: list[int], share: list[float], seed: str = "") -> list[float]:
    """Decides the few open shares: first the number of documents is kept and tokens are not, then neither is."""
    p = flight(tokens, share, seed + " landing", 1, balanced=False)
    draw = np.random.default_rng(list((seed + " last").encode()))
    return [x if x in (0.0, 1.0) else float(draw.random() < x) for x in p]


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    """Flight of one block; the only block of a source lands."""
    pdf = pdf.sort_values("doc_id")
    tokens = pdf["tokens"].astype(int).tolist()
    last = pdf["blocks"].iloc[0] == 1
    seed = f"{pdf['source'].iloc[0]} {len(tokens)} {sum(tokens)}"
    p = flight(tokens, pdf["open"].tolist(), seed)
    pdf["open"] = landing(tokens, p, seed) if last else p
    return pdf[["source", "doc_id", "tokens", "expected", "whole", "open"]]


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """Copies expected of each source's documents.  One row for each target, on the driver."""
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = [r.asDict() for r in goal.join(have, "source").where("tokens > 0 and repeats > 0").collect()]
    total = min((r["repeats"] * r["tokens"] / r["share"] for r in rows), default=0.0)
    return [r | {"expected": min(float(r["repeats"]), total * r["share"] / r["tokens"])} for r in rows]


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """source, doc_id, tokens, expected, copies (at least 1): the documents of the mix."""
    if block < 2 * LEFT:
        raise ValueError(f"blocks need at least {2 * LEFT} documents")
    spark = documents.sparkSession
    known = documents.join(targets.where("target_share > 0").select("source").distinct(), "source", "left_semi")
    sized = materialize(with_tokens(known, tokenizer), "tokens")
    rows = plan(sized, targets)
    if not rows:
        return spark.createDataFrame([], "source string, doc_id bigint, tokens bigint, expected double, copies int")
    blocks = {r["source"]: -(-r["documents"] // block) for r in rows}
    expected = spark.createDataFrame([(r["source"], r["expected"], blocks[r["source"]]) for r in rows], "source string, expected double, blocks int")
    units = sized.join(expected, "source")
    whole = F.floor(F.col("expected") + EPS).cast("int")
    units = units.withColumn("whole", whole).withColumn("open", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    columns = ["source", "doc_id", "tokens", "expected", "whole", "open"]
    done, salt = [units.where(f"open <= {EPS}").select(columns)], 0
    todo = units.where(f"open > {EPS}")
    while blocks:
        key = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("blocks")).alias("block")
        # tasks by the number of blocks, as the size of the shuffle says nothing about their work
        spread = todo.select(*columns, "blocks", key).repartition(min(MOST_TASKS, sum(blocks.values())), "source", "block")
        flown = materialize(spread.groupBy("source", "block").applyInPandas(_fly, FLOWN), "flown")
        done.append(flown.where("open in (0, 1)"))
        # at most LEFT open documents of each block go on, where a source has several
        blocks = {s: -(-LEFT * n // block) for s, n in blocks.items() if n > 1}
        if blocks:
            expected = spark.createDataFrame([*blocks.items()], "source string, blocks int")
            salt, todo = salt + 1, flown.where("open not in (0, 1)").join(expected, "source")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("source", "doc_id", "tokens", "expected", (F.col("whole") + F.round("open").cast("int")).alias("copies")).where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Target and actual share of tokens of each source, with documents and copies used."""
    used = mix(documents, targets, tokenizer).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    used = materialize(used, "shares")
    total = used.agg(F.sum("tokens")).first()[0] or 1  # one number
    rows = targets.select("source", "target_share", "max_repeats").join(used, "source", "left")
    return rows.withColumn("actual_share", F.coalesce(F.col("tokens"), F.lit(0)) / F.lit(total))


def promises(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source with a target: whether its tokens are within two documents (of the largest size used) of its share
    of all tokens, documents used too often, and documents listed more than once."""
    once = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"), F.max("tokens").alias("tokens"))
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    each = once.join(goal, "source").groupBy("source", "target_share").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("tokens").alias("largest"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("rows") > 1).alias("repeated")
    )
    each = materialize(each, "promises")
    total, largest = each.agg(F.sum("used"), F.max("largest")).first()  # two numbers
    near = F.abs(F.col("used") - F.col("target_share") * F.lit(total or 0)) <= 2 * F.lit(largest or 0)
    return each.select("source", near.alias("at_target"), "too_often", "repeated")
