"""Depth-first order of trees of any depth, given as parent links.

A tree is walked along its Euler tour: every node is entered and left once, and each of these steps has one successor.  The
place of a step is its distance to the end of the tour, found by pointer doubling: in each round every step skips to where its
successor skips, so a chain of n nodes takes about log2(2 n) rounds of joins on narrow rows, and neither a deep chain nor
a tree that holds a third of all nodes meets in one task.

Nodes whose parent is null or unknown are roots.  Nodes that no root reaches (on cycles or below them) follow in the order of
their ordinals: each begins a tree unless an earlier node above it did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomlog.operators.running import ranked
from loomlog.storage import materialize


def _key(*names: str):
    return F.concat_ws("\0", *(F.coalesce(F.col(n), F.lit("\1")) for n in names))


def _forest(nodes: DataFrame) -> DataFrame:
    """Nodes with the parent under which they are visited; null for those that begin a tree.  reached: by a root."""
    up = nodes.select(F.col("node").alias("p"), F.col("ordinal").alias("p_ordinal"))
    rows = materialize(nodes.join(up, F.col("parent") == F.col("p"), "left").withColumn("parent", F.col("p")), "links")
    # jump: an ancestor (null beyond a root), least: the smallest ordinal of the nodes up to it
    jumps = materialize(rows.select("node", F.col("parent").alias("jump"), F.col("p_ordinal").alias("least")), "jumps")
    n, step = rows.count(), 1
    while step < n and not jumps.where("jump is not null").isEmpty():
        further = jumps.select(F.col("node").alias("j"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        jumps = materialize(jumps.join(further, F.col("jump") == F.col("j"), "left").select("node", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least")), "jumps")
        step *= 2
    lost = jumps.select(F.col("node").alias("l"), F.col("jump").isNotNull().alias("lost"), "least")
    rows = rows.join(lost, F.col("node") == F.col("l"))
    begins = F.col("lost") & (F.col("ordinal") <= F.col("least"))  # on a cycle a node is above itself
    return rows.select("tree", "id", "node", F.when(~begins, F.col("parent")).alias("parent"), F.col("parent").alias("named"), "ordinal", "child_no", (~F.col("lost")).alias("reached"))


def preorder(nodes: DataFrame) -> DataFrame:
    """tree, id, parent, depth, position (from 1) of every node, in pre-order within its tree key.

    nodes: tree (a key), id (unique in it), parent, ordinal (order of the nodes in the source, unique in the tree), child_no
    (order among the children of a parent; null counts as last, ties by ordinal)."""
    rows = nodes.select("tree", "id", _key("tree", "id").alias("node"), F.when(F.col("parent").isNotNull(), _key("tree", "parent")).alias("parent"), "ordinal", "child_no")
    forest = materialize(_forest(materialize(rows, "nodes")), "forest")
    # siblings: children of a node, or the beginnings of a tree key, those that are roots first
    group = F.coalesce("parent", _key("tree"))
    late = F.col("parent").isNull() & ~F.col("reached")
    child = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.coalesce("child_no", F.lit(1 << 62)))
    numbered = forest.select("*", group.alias("group"), late.cast("int").alias("late"), child.alias("child"))
    # a node may have a third of all nodes as children: siblings are ranked on ranges, and joined by rank
    numbered = materialize(ranked(numbered, ["group"], [F.col("late"), F.col("child"), F.col("ordinal")], "k"), "siblings")
    after = numbered.select(F.col("group").alias("g"), (F.col("k") - 1).alias("before"), F.col("node").alias("next"))
    placed = materialize(numbered.join(after, (F.col("group") == F.col("g")) & (F.col("k") == F.col("before")), "left").withColumn("first", F.col("k") == 1), "siblings")
    firsts = placed.where("first and parent is not null").select(F.col("parent").alias("f"), F.col("node").alias("first_child"))
    tour = placed.join(firsts, F.col("node") == F.col("f"), "left")
    enter, leave = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    down = tour.select("tree", "id", enter(F.col("node")).alias("step"), F.coalesce(enter(F.col("first_child")), leave(F.col("node"))).alias("to"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d"))
    back = tour.select("tree", "id", leave(F.col("node")).alias("step"), F.coalesce(enter(F.col("next")), leave(F.col("parent"))).alias("to"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("d"))
    # n: nodes entered from here up to where the pointer leads; d: levels gone down on the way
    todo, done = materialize(down.unionByName(back), "tour"), []
    while not todo.where("to is not null").isEmpty():
        further = todo.select(F.col("step").alias("s"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        todo = materialize(
            todo.join(further, F.col("to") == F.col("s"), "left").select(
                "tree", "id", "step", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")
            ),
            "tour",
        )
    ends = todo.where("step like '+%'").select("tree", "id", "n", "d")
    total = forest.groupBy(F.col("tree").alias("t")).agg(F.count("*").alias("total"))
    named = forest.select(F.col("tree").alias("t2"), F.col("id").alias("i2"), F.element_at(F.split("named", "\0"), -1).alias("parent"))
    out = ends.join(total, F.col("tree").eqNullSafe(F.col("t"))).join(named, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("id") == F.col("i2")))
    # from the entry of a node at depth k to the end the tour goes up k + 1 levels and down again as often as it goes up
    return out.select("tree", "id", "parent", (-F.col("d")).alias("depth"), (F.col("total") - F.col("n") + 1).alias("position"))
