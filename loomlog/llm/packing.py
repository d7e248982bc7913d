"""Filling fixed-capacity containers by a grouping genetic algorithm on islands.

The instance is cut into cells of about CELL documents by a hash of their id.  A cell is first packed by largest-first best
fit.  Where that takes the least possible number of containers (a proven bound) there is nothing left to find; every other
cell is evolved on ISLANDS islands.  Their populations begin with best fit and with random orders.  A crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold duplicates, lets displaced documents take
the place of smaller ones in the bins that have room (which leaves smaller ones to place) and best-fits the rest.  After
each epoch the elite of an island migrates to the next one.  The best individual of a cell keeps its well-filled bins; what
lies in the others is hashed into fewer cells and packed again, with other neighbours.  A level is the last one of a kind
if it is one cell, or if it filled bins well for less than PROGRESS of its documents: then further levels would not either.
A text above the capacity is cut into full containers and a rest that is packed like any other.

Defined results for odd input: null and empty texts have size 0 and are placed too; capacities that are null or below 1
give no containers; several rows of one kind count as the largest capacity.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomlog.llm.tokens import TOKENIZER, with_tokens
from loomlog.storage import materialize

CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1000, 3, 2, 60, 8
#: A bin this full is kept when a cell is done; a level that places less than this share of its documents so is the last.
WELL_FILLED, PROGRESS = 0.985, 0.25
MOST_TASKS = 10_000

Bins = list[list[int]]


def room_in(sizes: list[int], capacity: int, group: list[int]) -> int:
    return capacity - sum(sizes[i] for i in group)


def best_fit(sizes: list[int], capacity: int, bins: Bins, rest: list[int], ordered: bool = False) -> Bins:
    """Adds rest to bins, largest first (or in the order given), each to the fullest bin that takes it."""
    bins = [list(b) for b in bins]
    free = sorted((room_in(sizes, capacity, b), k) for k, b in enumerate(bins))
    for i in rest if ordered else sorted(rest, key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        insort(free, (room - sizes[i], k))
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: the total over the capacity, and, for each smallest size that counts, one container for each item
    above half the capacity plus what does not fit beside them."""
    s = sorted(sizes)
    upto = [0, *accumulate(s)]
    half = bisect_right(s, capacity // 2)
    best = max(len(s) - half, -(-upto[-1] // capacity))
    for smallest in sorted(set(s[:half])):
        alone = bisect_right(s, capacity - smallest)  # items from here on share with none that counts
        beside = (alone - half) * capacity - (upto[alone] - upto[half])
        over = upto[half] - upto[bisect_left(s, smallest)] - beside
        best = max(best, len(s) - half + max(0, -(-over // capacity)))
    return best


def fitness(sizes: list[int], capacity: int, bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then bins filled as unevenly as possible."""
    return -len(bins), sum((1 - room_in(sizes, capacity, b) / capacity) ** 2 for b in bins)


def exchange(sizes: list[int], capacity: int, bins: Bins, rest: list[int]) -> list[int]:
    """Puts displaced items in the place of one or two smaller ones of a bin that then fits better; changes bins, returns
    what is displaced afterwards."""
    rest = sorted(rest, key=lambda i: (sizes[i], i))
    for b in bins:
        room = room_in(sizes, capacity, b)
        while room and rest:
            best = (0, -1, ())
            for x in range(len(b)):
                for out in ((x,), *((x, y) for y in range(x))):
                    given = sum(sizes[b[k]] for k in out)
                    at = bisect_right(rest, given + room, key=lambda i: sizes[i]) - 1
                    if at >= 0 and sizes[rest[at]] - given > best[0]:
                        best = (sizes[rest[at]] - given, at, out)
            gain, at, out = best
            if not gain:
                break
            taken = rest.pop(at)
            for k in out:  # larger places first, so that the others stay where they are
                insort(rest, b.pop(k), key=lambda i: sizes[i])
            b.append(taken)
            room -= gain
    return rest


def crossover(sizes: list[int], capacity: int, a: Bins, b: Bins, draw: random.Random) -> Bins:
    """Child of a with whole well-filled bins of b."""
    fullest = sorted(range(len(b)), key=lambda k: room_in(sizes, capacity, b[k]))
    good = fullest[: max(1, len(fullest) // 2)]
    injected = [list(b[k]) for k in draw.sample(good, max(1, int(len(good) * draw.uniform(0.1, 0.6))))]
    taken = {i for g in injected for i in g}
    bins = [list(g) for g in a if taken.isdisjoint(g)] + injected
    displaced = [i for g in a if not taken.isdisjoint(g) for i in g if i not in taken]
    return best_fit(sizes, capacity, bins, exchange(sizes, capacity, bins, displaced))


def mutate(sizes: list[int], capacity: int, bins: Bins, draw: random.Random) -> Bins:
    """Empties the least filled bins and a few others and places their documents again."""
    order = sorted(range(len(bins)), key=lambda k: -room_in(sizes, capacity, bins[k]))
    out = set(order[: max(1, len(bins) // 20)]) | set(draw.sample(order, max(1, len(bins) // 15)))
    kept = [list(b) for k, b in enumerate(bins) if k not in out]
    draw.shuffle(kept)
    return best_fit(sizes, capacity, kept, exchange(sizes, capacity, kept, [i for k in out for i in bins[k]]))


def evolve(sizes: list[int], capacity: int, population: list[Bins], least: int, seed: str, generations: int = GENERATIONS) -> list[Bins]:
    """The next population, best first, until one takes the least possible number of bins.

    Missing individuals begin with half of the items in random order."""
    draw = random.Random(seed)
    everyone = list(range(len(sizes)))
    while len(population) < POPULATION:
        order = draw.sample(everyone, len(everyone))
        half = len(order) // 2
        population = [*population, best_fit(sizes, capacity, best_fit(sizes, capacity, [], order[:half], ordered=True), order[half:])]
    ranked = sorted(((fitness(sizes, capacity, p), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1]) <= least:
            break
        a, b = (ranked[k][1] for k in draw.sample(range(len(ranked)), 2)) if len(ranked) > 1 else (ranked[0][1],) * 2
        child = crossover(sizes, capacity, a, b, draw)
        if draw.random() < 0.5:
            child = mutate(sizes, capacity, child, draw)
        rank = fitness(sizes, capacity, child)
        if all(rank != r for r, _ in ranked):  # equal individuals would crowd out the others
            ranked = sorted([*ranked, (rank, child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, p in ranked]


# ------------------------------------------------------------------------------------------------ cells

_CELL = "container_kind string, capacity int, cell bigint, docs array<bigint>, pieces array<int>, sizes array<int>"
BEGUN = f"{_CELL}, best_fit array<int>, best_fit_bins int, least int"
EVOLVED = "container_kind string, capacity int, cell bigint, island int, sizes array<int>, least int, population array<array<int>>"
PLACED = "container_kind string, capacity int, cell bigint, bin int, fill int, doc_id bigint, piece int, size int, least int, best_fit_bins int, bins int, evolved boolean"


def _to_bins(numbers: list[int]) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


def _numbers(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        begun, bins, least = [], [], []
        for capacity, sizes in zip(pdf["capacity"], pdf["sizes"]):
            sizes, capacity = [int(s) for s in sizes], int(capacity)
            packed = best_fit(sizes, capacity, [], list(range(len(sizes))))
            begun.append(_numbers(packed, len(sizes)))
            bins.append(len(packed))
            least.append(least_containers(sizes, capacity))
        yield pdf.assign(best_fit=begun, best_fit_bins=bins, least=least)


def _epoch(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            evolved = []
            for kind, capacity, cell, island, sizes, least, numbers in zip(*(pdf[c] for c in ("container_kind", "capacity", "cell", "island", "sizes", "least", "population"))):
                sizes = [int(s) for s in sizes]
                population = [_to_bins(list(x)) for x in numbers]
                evolved.append([_numbers(b, len(sizes)) for b in evolve(sizes, int(capacity), population, int(least), f"{kind} {cell} {island} {number}")])
            yield pdf.assign(population=evolved)

    return run


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best of a cell's individuals, one row for each document."""
    for pdf in batches:
        rows = []
        columns = ("container_kind", "capacity", "cell", "docs", "pieces", "sizes", "best_fit", "least", "elites")
        for kind, capacity, cell, docs, pieces, sizes, begun, least, elites in zip(*(pdf[c] for c in columns)):
            sizes, capacity = [int(s) for s in sizes], int(capacity)
            given = [] if elites is None else [_to_bins(list(e)) for e in elites]
            first = _to_bins(list(begun))
            best = max([first, *given], key=lambda b: fitness(sizes, capacity, b))
            for k, b in enumerate(best):
                fill = sum(sizes[i] for i in b)
                rows += [(kind, capacity, int(cell), k, fill, int(docs[i]), int(pieces[i]), sizes[i], int(least), len(first), len(best), bool(given)) for i in b]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])


def _pack(items: DataFrame, cells: DataFrame, level: int) -> DataFrame:
    """One level: items of each kind hashed into its number of cells, packed, hard cells evolved, best individuals chosen."""
    spread = items.join(cells, "container_kind").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.col("cells")))
    grouped = spread.groupBy("container_kind", "capacity", "cell").agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("rows"))
    grouped = grouped.select("container_kind", "capacity", "cell", F.col("rows.doc_id").alias("docs"), F.col("rows.piece").alias("pieces"), F.col("rows.size").alias("sizes"))
    begun = materialize(grouped.mapInPandas(_begin, BEGUN), "cells")
    hard = begun.where("best_fit_bins > least")
    # a few rows are minutes of work: tasks by their number, as the size of the shuffle says nothing about it
    tasks = min(MOST_TASKS, max(1, hard.count() * ISLANDS // 2))
    keys = ["container_kind", "cell", "island"]
    islands = F.explode(F.array(*(F.lit(k) for k in range(ISLANDS))))
    state = hard.select("container_kind", "capacity", "cell", islands.alias("island"), "sizes", "least", F.array("best_fit").alias("population")).repartition(tasks, *keys)
    for epoch in range(EPOCHS):
        state = materialize(state.mapInPandas(_epoch(epoch + 10 * level), EVOLVED), "islands")
        if epoch < EPOCHS - 1:
            elites = state.select("container_kind", "cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("population", 1, 1).alias("elite"))
            own = F.slice("population", 1, POPULATION - 1)
            state = state.join(elites, keys).withColumn("population", F.concat(own, "elite")).drop("elite").repartition(tasks, *keys)
    best = state.groupBy("container_kind", "cell").agg(F.collect_list(F.get("population", F.lit(0))).alias("elites"))
    return begun.join(best, ["container_kind", "cell"], "left").mapInPandas(_choose, PLACED)


SEARCH = "container_kind string, level int, cells bigint, evolved_cells bigint, documents bigint, least bigint, best_fit bigint, containers bigint"


def pack_with_search(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The placement (see pack), and what the search did in each level: cells, cells evolved, the bound, best fit, result.

    limits holds a row for each container kind; their number bounds what the driver sees."""
    spark = documents.sparkSession
    kinds = [(r[0], r[1]) for r in limits.where("capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens")).collect()]
    columns = ["container_kind", "container_id", "doc_id", "piece", "tokens", "capacity_tokens"]
    if not kinds:
        none = "container_kind string, container_id string, doc_id bigint, piece int, tokens int, capacity_tokens int"
        return spark.createDataFrame([], none), spark.createDataFrame([], SEARCH)
    sized = materialize(with_tokens(documents, tokenizer).select("doc_id", "tokens"), "tokens")
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity")) for k, c in kinds))).alias("k")
    every = sized.select("doc_id", "tokens", kind).select("doc_id", "tokens", "k.*")
    full = every.where("tokens > capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor(F.col("tokens") / F.col("capacity")) - 1).cast("int"))))
    whole = full.select(
        "container_kind", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", F.col("capacity").alias("tokens"), F.col("capacity").alias("capacity_tokens")
    )
    over = F.col("tokens") > F.col("capacity")
    items = every.select(
        "container_kind",
        "capacity",
        "doc_id",
        F.when(over, F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("int").alias("piece"),
        F.when(over, F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).cast("int").alias("size"),
    ).where("size > 0 or piece = 0")
    done, search, level = [whole], [], 0
    counts = dict(items.groupBy("container_kind").count().collect())  # a row for each kind
    good = F.col("fill") >= WELL_FILLED * F.col("capacity")
    while counts:
        cells = {k: max(1, round(n / cell)) for k, n in counts.items()}
        placed = materialize(_pack(items, spark.createDataFrame([*cells.items()], "container_kind string, cells bigint"), level), "placed")
        each = placed.groupBy("container_kind", "cell").agg(F.count("*").alias("documents"), F.count_if(good).alias("good"), *(F.first(c).alias(c) for c in ("least", "best_fit_bins", "bins", "evolved")))
        stats = each.groupBy("container_kind").agg(
            F.count("*"), F.count_if("evolved"), F.sum("documents"), F.sum("least"), F.sum("best_fit_bins"), F.sum("bins"), F.sum("good")
        ).collect()  # a row for each kind
        search += [(r[0], level, *r[1:7]) for r in stats]
        last = {r[0] for r in stats if cells[r[0]] == 1 or r[7] < PROGRESS * r[3]}
        kept = placed.where(good | F.col("container_kind").isin(*last)) if last else placed.where(good)
        done.append(
            kept.select("container_kind", F.concat_ws("-", F.lit(level), "cell", "bin").alias("container_id"), "doc_id", "piece", F.col("size").alias("tokens"), F.col("capacity").alias("capacity_tokens"))
        )
        items = placed.where(~good & ~F.col("container_kind").isin(*last) if last else ~good).select("container_kind", "capacity", "doc_id", "piece", "size")
        counts, level = {r[0]: r[3] - r[7] for r in stats if r[0] not in last and r[3] > r[7]}, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(columns), spark.createDataFrame(search, SEARCH)


def pack(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, cell: int = CELL) -> DataFrame:
    """container_kind, container_id, doc_id, piece, tokens, capacity_tokens: every document of every kind, placed."""
    return pack_with_search(documents, limits, tokenizer, cell)[0]


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens, least possible number of containers and share of used space of each kind."""
    kinds = packed.groupBy("container_kind", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return kinds.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def promises(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """For each kind: documents placed, documents placed more often than cut, containers above their capacity, texts cut
    although they fit, documents that are nowhere."""
    each = packed.groupBy("container_kind", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    small = F.col("size") <= F.col("capacity_tokens")
    most = F.ceil(F.col("size") / F.col("capacity_tokens"))
    kinds = each.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(small & (F.col("n") > 1)).alias("cut_though_fitting"), F.count_if(~small & (F.col("n") > most)).alias("cut_too_often"))
    over = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("fill"))
    over = over.groupBy("container_kind").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("overfull"))
    everyone = documents.agg(F.count_distinct("doc_id")).first()[0]  # one number
    return kinds.join(over, "container_kind").select("container_kind", "documents", "cut_though_fitting", "cut_too_often", "overfull", (F.lit(everyone) - F.col("documents")).alias("missing"))
