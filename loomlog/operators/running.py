"""Skew-safe running aggregates.

A plain ordered window puts a whole key into one task.  Here a key is cut into blocks of its order column: an aggregate
for each (key, block), a window over these few block rows, and a window inside each block.  A key that holds a third of
all rows is thus spread over its blocks.  Works for sum, max and min, which combine associatively; a running last
value is the max of a struct that begins with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlog.storage import materialize

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def _pick(kind: str, a: Column, b: Column, struct: bool) -> Column:
    if not struct:
        return _COMBINE[kind][1](a, b)
    better = a >= b if kind == "max" else a <= b  # structs compare by their fields
    return F.when(a.isNull(), b).when(b.isNull(), a).when(better, a).otherwise(b)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    before_only: bool = False,
    backwards: bool = False,
    block: int = 4096,
) -> DataFrame:
    """df with, for each name, (kind, column) aggregated over the rows of the key up to this one in order.

    before_only leaves the row itself (and rows of equal order) out; backwards runs from the end.  Rows without an order
    form a block of their own, before all others.  Null keys are one key."""
    at = F.coalesce(F.floor(F.col(order) / block), F.lit(-1)).alias("_block")
    rows = df.select("*", at)
    for n, (_, c) in values.items():
        rows = rows.withColumn(f"_in_{n}", c)
    parts = rows.groupBy(*keys, "_block").agg(*(_COMBINE[k][0](f"_in_{n}").alias(f"_part_{n}") for n, (k, _) in values.items()))
    sign = (lambda c: F.col(c).desc_nulls_last()) if backwards else (lambda c: F.col(c).asc_nulls_first())
    across = W.partitionBy(*keys).orderBy(sign("_block")).rowsBetween(W.unboundedPreceding, -1)
    earlier = parts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), *(_COMBINE[k][0](f"_part_{n}").over(across).alias(f"_before_{n}") for n, (k, _) in values.items()))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(earlier, same)
    inside = W.partitionBy(*keys, "_block").orderBy(sign(order))
    inside = inside.rangeBetween(W.unboundedPreceding, -1) if before_only else inside.rangeBetween(W.unboundedPreceding, 0)
    kinds = dict(rows.dtypes)
    for n, (k, _) in values.items():
        own = _COMBINE[k][0](f"_in_{n}").over(inside)
        out = out.withColumn(n, _pick(k, F.col(f"_before_{n}"), own, kinds[f"_in_{n}"].startswith("struct")))
    return out.drop("_block", "_b", *(f"_k_{k}" for k in keys), *(f"_{p}_{n}" for n in values for p in ("in", "before")))


def running_floor(df: DataFrame, keys: list[str], order: str, value: Column, block: int = 4096) -> DataFrame:
    """df with level, the running sum of value, and low, the least level of the rows before (null if there are none).

    One pass for both: a block is summed up by its sum and the least level inside it, which earlier blocks then move."""
    rows = df.select("*", F.coalesce(F.floor(F.col(order) / block), F.lit(-1)).alias("_block"), value.alias("_v"))
    inside = W.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first())
    rows = rows.withColumn("_c", F.sum("_v").over(inside.rangeBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_least", F.min("_c").over(inside.rangeBetween(W.unboundedPreceding, -1)))
    parts = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"), F.min("_c").alias("_floor"))
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
    parts = parts.withColumn("_before", F.min(F.col("_base") + F.col("_floor")).over(across))
    earlier = parts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), "_base", "_before")
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(earlier, same).withColumn("level", F.col("_base") + F.col("_c")).withColumn("low", F.least("_before", F.col("_base") + F.col("_least")))
    return out.drop("_block", "_v", "_c", "_least", "_b", "_base", "_before", *(f"_k_{k}" for k in keys))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) within its key, for orders of any type; order has to decide every tie.

    Rows are cut into ranges of (key, order), ranked inside each range, and moved up by what the ranges before hold of their
    key, so a key that holds a third of all rows is spread over its ranges."""
    spread = df.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys), *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(spread, "ranges")
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    across = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return rows.join(before, same).withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_range", "_r", "_before", *(f"_k_{k}" for k in keys))
