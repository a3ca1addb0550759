"""Ordered work on groups of any size.

A window over one key runs in one task, so a key that holds a large share of all
rows would not fit. Everything here splits a key's ordered rows into blocks of
bounded size, works inside the blocks, and carries one summary row per block
across. The order-preserving block number must be a column or expression of the
rows themselves, or be stored with them, so that a lost task recomputes to the
same result. Rows with a NULL key or block are a group or block of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixatio.plans.stages import keep

UNB, CUR = Window.unboundedPreceding, Window.currentRow
# Distinct values that one task may hold in order at a time.
BLOCK_VALUES = 1 << 20
# Quantiles: accuracy of the sketch, half the share of rows that a bracket holds (its error and
# two rows of the smallest key with one), and keys that are kept whole.
SKETCH, BRACKET, SMALL_KEY = 10_000, 0.001, 4096


def block(c: str | Column, size: int) -> Column:
    """Block number of a whole-number position."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size)).cast("long")


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def join_blocks(rows: DataFrame, blocks: DataFrame, part: Sequence[str]) -> DataFrame:
    """Inner join on keys and block, where NULL meets NULL."""
    right = blocks.withColumnsRenamed({k: f"_j_{i}" for i, k in enumerate(part)})
    cond = F.lit(True)
    for i, k in enumerate(part):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j_{i}"))
    return rows.join(right, cond).drop(*[f"_j_{i}" for i in range(len(part))])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, block_col: Column, out: str,
    total: str | None = None,
) -> DataFrame:
    """Row number 1.. inside each key, in the given order, and the key's row count if asked.

    ``block_col`` must not decrease along the order.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", block_col)
    part = [*keys, "_blk"]
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(UNB, -1)
    add = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = sizes.select(
        *part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *add
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        join_blocks(rows.withColumn(out, local), offsets, part)
        .withColumn(out, (F.col(out) + F.col("_off")).cast("long"))
        .drop("_blk", "_off")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block_col: Column, cols: dict[str, str]
) -> DataFrame:
    """Add, for each ``new: old`` in cols, the value of ``old`` on the row before in the key.

    Rows whose ``old`` values are NULL take part like any other row.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", block_col)
    part = [*keys, "_blk"]
    w = Window.partitionBy(*part).orderBy(*order)
    rows = rows.withColumn("_first", F.row_number().over(w) == 1)
    for new, old in cols.items():
        rows = rows.withColumn(new, F.lag(old).over(w))
    last = F.max(F.struct(*order, *[F.col(old).alias(f"_v_{new}") for new, old in cols.items()]))
    across = Window.partitionBy(*keys).orderBy("_blk")
    tails = (
        df.withColumn("_blk", block_col)
        .groupBy(*part)
        .agg(last.alias("_t"))
        .select(*part, *[F.lag(f"_t._v_{new}").over(across).alias(f"_c_{new}") for new in cols])
    )
    out = join_blocks(rows, tails, part)
    for new in cols:
        out = out.withColumn(
            new, F.when(F.col("_first"), F.col(f"_c_{new}")).otherwise(F.col(new))
        ).drop(f"_c_{new}")
    return out.drop("_blk", "_first")


def cumulate_values(
    counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
    block_values: int | None = None, keep_block: bool = False,
) -> DataFrame:
    """For one row per distinct value: ``<s>_before`` (sum over smaller values) and ``<s>_total``.

    The rows are stored with the number of their block: ranges of (keys, value) of at most
    about ``block_values`` rows, as many as the rows need. A key's values may lie in any number
    of ranges. Both branches below read the stored numbers, so where the cuts fall, which is
    drawn from a sample, can only change how even the blocks are.
    """
    keys = list(keys)
    stored = keep(counts)
    n_blocks = max(1, math.ceil(stored.count() / (block_values or BLOCK_VALUES)))
    if n_blocks == 1:
        rows = stored.withColumn("_blk", F.lit(0))
    else:
        ranges = stored.repartitionByRange(n_blocks, *keys, value)
        rows = keep(ranges.withColumn("_blk", F.spark_partition_id()))
    part = [*keys, "_blk"]
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_blk").rowsBetween(UNB, -1)
    sizes = rows.groupBy(*part).agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    sizes = sizes.select(
        *part,
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(UNB, -1)
    local = {f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    rows = join_blocks(rows.withColumns(local), sizes, part)
    total = {f"{s}_before": F.col(f"{s}_before") + F.col(f"_off_{s}") for s in sums}
    out = rows.withColumns(total).drop(*[f"_off_{s}" for s in sums])
    return out if keep_block else out.drop("_blk")


def min_from_here(
    rows: DataFrame, keys: Sequence[str], value: str, measure: str, out: str
) -> DataFrame:
    """Smallest ``measure`` over this and all larger values of ``value``.

    ``rows`` has one row per distinct value, with its ``_blk`` from :func:`cumulate_values`.
    """
    part = [*keys, "_blk"]
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(CUR, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
    per_block = rows.groupBy(*part).agg(F.min(measure).alias("_m"))
    per_block = per_block.select(*part, F.min("_m").over(later).alias("_later"))
    local = join_blocks(rows.withColumn(out, F.min(measure).over(inside)), per_block, part)
    return local.withColumn(out, F.least(out, "_later")).drop("_later")


def rank_table(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of each distinct value in each key (ties share the mean of their ranks).

    Ties are folded to one row first, so a value that fills most rows costs one row.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return cumulate_values(counts, keys, value, ["_n"]).select(
        *keys, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out)
    )


def average_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Add average ranks inside each key: ``new: value`` column names.

    Reads ``df`` once per value and once for the rows, so give it as a cheap plan.
    """
    out = df
    for new, value in values.items():
        out = out.join(rank_table(df, keys, value, new), [*keys, value])
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key; NULLs are left out.

    A mergeable sketch brackets the position of each quantile in its key. One pass counts what
    lies below a bracket and keeps the values in it, a few thousandths of the rows; only these are put
    in order. Keys of at most ``SMALL_KEY`` rows are bracketed by everything. Should a sketch be
    farther off than it promises, the brackets are widened. Reads ``df`` twice.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    for margin in (BRACKET, 32 * BRACKET, 1.0):
        found, certain = _bracketed(rows, keys, list(probs.values()), margin)
        if certain:
            break
        found = keep(found)
        missing = [F.col(f"_{side}_{i}").isNull() for side in ("lo", "hi") for i in range(len(probs))]
        if found.filter(reduce(Column.__or__, missing)).isEmpty():
            break
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{i}") + (F.col(f"_hi_{i}") - F.col(f"_lo_{i}")) * F.col(f"_w_{i}")).alias(n)
            for i, n in enumerate(probs)
        ],
    )


def _bracketed(rows: DataFrame, keys: list[str], probs: list[float], margin: float) -> tuple[DataFrame, bool]:
    """The values on both sides of each position, and its fraction; whether none can be missing."""
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    small = F.lit(True) if margin >= 1 else F.col("_size") <= SMALL_KEY
    sketch = keep(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.percentile_approx("_v", ends, SKETCH).alias("_s")
    ).select(*keys, "_size", *[
        F.when(small, F.lit(limit)).otherwise(F.col("_s")[2 * i + j]).alias(f"_{name}_{i}")
        for i in range(len(probs)) for j, (name, limit) in enumerate((("from", -math.inf), ("to", math.nan)))  # NaN is last
    ]))
    near = join_blocks(rows, sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    # What is below a bracket counts as NULL, which comes first in order; what is above does not matter.
    hits = F.array(*[
        F.when(F.col("_v") <= F.col(f"_to_{i}"), F.struct(F.lit(i).alias("_i"), F.when(F.col("_v") >= F.col(f"_from_{i}"), F.col("_v")).alias("_v")))
        for i in range(len(probs))
    ])
    counts = near.select(*keys, "_size", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("_h")).groupBy(
        *keys, "_h._i", "_h._v"
    ).agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"))
    placed = cumulate_values(counts, [*keys, "_i"], "_v", ["_n"])
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("_i") == i) & (F.col("_n_before") <= at) & (at < F.col("_n_before") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{i}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_w_{i}"))
    # Small keys are kept whole, and so is every key once the bracket is everything.
    certain = margin >= 1 or sketch.filter(~small).isEmpty()
    return placed.groupBy(*keys).agg(*picks), certain
