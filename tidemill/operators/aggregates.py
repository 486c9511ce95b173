"""Running, grouped, sliding and tumbling counts and sums.

Sums are decimals or whole numbers where they can be, so they do not depend on the
order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import COMPARISONS, ignore_case
from .sequencing import block_number, bucket_of, check_window, running, with_sequence
from .window_join import banded_join


def running_count(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    return running(df, order, {name: ("count", F.lit(1))})[0]


def running_sum(df: DataFrame, order: str, value: Column, name: str = "total") -> DataFrame:
    """The sum starts at 0; NULLs add nothing."""
    return running(df, order, {name: ("sum", value)})[0]


def group_running_count(df: DataFrame, keys: Sequence[str], order: str, name: str = "n") -> DataFrame:
    """Running count per group, keys compared without case and shown in the first spelling seen.

    The groups' rows are numbered in buckets of the order column first, so a hot
    group is not one task's.
    """
    joined = F.concat_ws(",", *keys)
    shown = df.select("*", ignore_case(joined).alias("_k"), joined.alias("_shown"))
    numbered, _ = with_sequence(shown.select(order, "_k", "_shown"), order, "_seq")
    block = numbered.withColumn("_block", block_number(F.col("_seq"), 1 << 16))
    per = block.groupBy("_k", "_block").agg(F.count("*").alias("_c"), F.min(F.struct("_seq", "_shown")).alias("_f"))
    w = Window.partitionBy("_k").orderBy("_block")
    before = per.select(
        "_k", "_block", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.min("_f").over(Window.partitionBy("_k"))["_shown"].alias("key"),
    )
    local = block.select(order, "_k", "_block", F.count("*").over(Window.partitionBy("_k", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)).alias("_local"))
    return local.join(before, ["_k", "_block"]).select(order, "key", (F.col("_local") + F.col("_before")).alias(name))


def sliding_group_count(df: DataFrame, key: str, ms: str, order: str, window: int, slide: int, name: str = "n") -> DataFrame:
    """For each row, the rows of its key so far, itself included, whose bucket is alive.

    Counts are kept per (key, bucket): a row adds the full buckets before its own,
    and the rows of its own bucket that came before it.
    """
    check_window(window, slide)
    cap = window // slide
    t0 = df.agg(F.min(ms)).first()[0] or 0
    b = df.select(key, ms, order, bucket_of(F.col(ms), t0, slide).alias("_b"))
    per = b.groupBy(F.col(key), F.col("_b").alias("s_b")).agg(F.count("*").alias("s_n"))
    alive = F.floor((F.col(ms) - F.lit(t0 + window)) / F.lit(slide + 1)).cast("long") + 1
    probe = b.select(F.col(key).alias(key), ms, order, "_b", F.greatest(alive, F.col("_b") - (cap - 1)).alias("_lo"), (F.col("_b") - 1).alias("_hi"))
    older = banded_join(per, probe, key, "s_b", "_lo", "_hi", cap + 1).groupBy(order).agg(F.sum("s_n").alias("_older"))
    own = b.withColumn("_own", F.count("*").over(Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(older, order, "left").select(order, key, ms, (F.col("_own") + F.coalesce("_older", F.lit(0))).alias(name))


def sliding_group_count_range(df: DataFrame, key: str, ms: str, order: str, window: int, name: str = "n") -> DataFrame:
    """For each row, the rows of its key in the ``window`` ms up to it (peers included).

    A key's rows lie in blocks of ``window`` ms.  A row enters in its own block and leaves in the
    next one, so a block's rows and those of the block before suffice.
    """
    block = F.floor(F.col(ms) / F.lit(window)).cast("long")
    own = df.select(order, key, ms, block.alias("_block"), F.col(ms).cast("long").alias("_at"), F.lit(1).alias("_step"))
    gone = df.select(F.lit(None).cast(dict(df.dtypes)[order]).alias(order), key, F.lit(None).cast(dict(df.dtypes)[ms]).alias(ms), (block + 1).alias("_block"), (F.col(ms) + window).cast("long").alias("_at"), F.lit(-1).alias("_step"))
    w = Window.partitionBy(key, "_block")
    alive = F.count_if(F.col("_step") < 0).over(w) + F.sum("_step").over(w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    return own.unionByName(gone).withColumn(name, alive).filter("_step > 0").select(order, key, ms, name)


def hopping_group_count(df: DataFrame, key: str, ms: str, window: int, slide: int, name: str = "n") -> DataFrame:
    """Counts of the windows [k * slide, k * slide + window) in epoch ms; counted per slide first, then spread."""
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    panes = df.groupBy(F.col(key), F.floor(F.col(ms) / F.lit(slide)).cast("long").alias("_pane")).agg(F.count("*").alias("_n"))
    spread = panes.select(key, "_n", F.explode(F.sequence(F.col("_pane") - (window // slide - 1), F.col("_pane"))).alias("_w"))
    return spread.groupBy(key, (F.col("_w") * slide).alias("window_start")).agg(F.sum("_n").alias(name))


def _blocks(df: DataFrame, order: str, size: int) -> DataFrame:
    if size < 1:
        raise ValueError("a block must hold at least one row")
    numbered, n = with_sequence(df, order, "_seq")
    return numbered.filter(F.col("_seq") <= n // size * size).withColumn("block", block_number(F.col("_seq"), size))


def tumbling_count_if(df: DataFrame, order: str, size: int, column: str, op: str, value, name: str = "n") -> DataFrame:
    """Rows that match in each complete block of ``size`` arrivals."""
    test = ignore_case(F.col(column)) == ignore_case(F.lit(value)) if op == "eq" else COMPARISONS[op](F.col(column).try_cast("bigint"), F.lit(value).cast("bigint"))
    return _blocks(df, order, size).groupBy("block").agg(F.count_if(test).alias(name))


def tumbling_sum(df: DataFrame, order: str, size: int, value: Column, name: str = "total", positive_only: bool = False) -> DataFrame:
    """Sum of each complete block of ``size`` arrivals."""
    out = _blocks(df, order, size).groupBy("block").agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))
    return out.filter(F.col(name) > 0) if positive_only else out
