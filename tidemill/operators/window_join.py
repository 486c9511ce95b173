"""Joins over sliding time windows and count windows.

Every join is an equi-join on the key and on a *block* of the position (time bucket
or arrival number), with the exact bounds as a filter.  A probe's interval is not
longer than a block, so it is dealt to two blocks at most.  A hot key is thereby
spread over its blocks, and no key's rows meet all of its other rows.  Theta joins
have no key; their blocks are spread over shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import COMPARISONS
from .sequencing import bucket_of, check_window, running


#: Shares of a block's stored rows in a join without a key.
SHARES = 16


def banded_join(stored: DataFrame, probes: DataFrame, key: str | None, position: str, low: str, high: str, width: int, extra: Column | None = None) -> DataFrame:
    """stored ⋈ probes on equal ``key`` (if any) where low <= position <= high; high - low < width.

    The sides' other columns must differ; ``extra`` is a further condition.  Without a key, a
    block's stored rows are dealt out to SHARES and each probe goes to all of them, so that
    a full block is many tasks'.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = stored.withColumn("_block", block(position))
    right = probes.filter(F.col(low) <= F.col(high)).withColumn("_block", F.explode(F.sequence(block(low), block(high))))
    if key is not None:
        right = right.withColumnRenamed(key, "_key")
    else:
        left = left.withColumn("_share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in stored.columns]), F.lit(SHARES)).cast("int"))
        right = right.withColumn("_probed", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    on = (left["_block"] == right["_block"]) & (F.col(position) >= F.col(low)) & (F.col(position) <= F.col(high))
    if key is not None:
        on = on & (F.col(key) == F.col("_key"))
    else:
        on = on & (F.col("_share") == F.col("_probed"))
    if extra is not None:
        on = on & extra
    return left.join(right, on).drop(left["_block"]).drop(right["_block"]).drop("_key", "_share", "_probed")


def _sides(stored: DataFrame, probes: DataFrame, key: str, ms: str, order: str) -> tuple[DataFrame, DataFrame]:
    for df in (stored, probes):
        missing = {key, ms, order} - set(df.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
    name = lambda df, p: df.select(F.col(key).alias("key" if p == "s" else "key"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
    return name(stored, "s"), name(probes, "p")


def sliding_equi_join(stored: DataFrame, probes: DataFrame, key: str, ms: str, order: str, window: int, slide: int, t0: int | None = None, dedup: bool = False) -> DataFrame:
    """One-sided sliding-window hash join: each probe meets the stored rows that arrived before it and are alive.

    Columns: key, s_* and p_*.  ``order`` is the arrival number over both sides;
    ``t0`` is the first stored row's time unless given.  ``dedup`` drops equal stored
    rows (all columns but ``order`` and ``ms``) of one bucket.
    """
    cap = check_window(window, slide)
    s, p = _sides(stored, probes, key, ms, order)
    if t0 is None:
        t0 = stored.agg(F.min(ms)).first()[0] or 0
    s = s.withColumn("s_b", bucket_of(F.col(f"s_{ms}"), t0, slide))
    if dedup:
        same = ["key", "s_b", *[c for c in s.columns if c not in ("key", "s_b", f"s_{ms}", f"s_{order}")]]
        first = s.groupBy(*same).agg(F.min(F.struct(f"s_{order}", f"s_{ms}")).alias("_first"))
        s = first.select(*same, F.col(f"_first.s_{order}"), F.col(f"_first.s_{ms}"))
    alive = F.floor((F.col(f"p_{ms}") - F.lit(t0 + window)) / F.lit(slide + 1)).cast("long") + 1
    newest = bucket_of(F.col(f"p_{ms}"), t0, slide)
    if cap * (slide + 1) < window:  # the ring of buckets ends before the window does
        both = s.select(F.col(f"s_{order}").alias("_o"), F.col("s_b").alias("_b")).union(p.select(F.col(f"p_{order}"), F.lit(None).cast("long")))
        seen = running(both, "_o", {"_newest": ("max", F.col("_b"))})[0].filter("_b is null").select("_o", "_newest")
        p = p.join(seen, p[f"p_{order}"] == seen["_o"]).drop("_o", "_b")
        p = p.withColumn("_lo", F.greatest(alive, F.col("_newest") - (cap - 1))).drop("_newest")
    else:
        p = p.withColumn("_lo", alive)
    p = p.withColumn("_hi", newest).filter("_lo is not null")
    # (window - 1) / (slide + 1) + 1 buckets can be alive
    width = window // (slide + 1) + 2
    out = banded_join(s, p, "key", "s_b", "_lo", "_hi", width, F.col(f"s_{order}") < F.col(f"p_{order}"))
    return out.drop("_lo", "_hi", "s_b")


def symmetric_sliding_join(left: DataFrame, right: DataFrame, key: str, ms: str, order: str, window: int, slide: int, dedup: bool = False, t0: int | None = None) -> DataFrame:
    """Both directions over one ring: columns key, l_*, r_* whichever side came first.

    ``t0`` is the first row's time of both sides unless given.
    """
    cap = check_window(window, slide)
    t0 = t0 if t0 is not None else min([x for x in (left.agg(F.min(ms)).first()[0], right.agg(F.min(ms)).first()[0]) if x is not None], default=0)

    def one(stored, probes, a, b):
        out = _ring_join(stored, probes, key, ms, order, window, slide, t0, cap, dedup)
        return out.select("key", *[F.col(c).alias(c.replace("s_", a, 1) if c.startswith("s_") else c.replace("p_", b, 1)) for c in out.columns if c != "key"])

    return one(left, right, "l_", "r_").unionByName(one(right, left, "r_", "l_"))


def _ring_join(stored, probes, key, ms, order, window, slide, t0, cap, dedup):
    """As the one-sided join, but probes roll the ring too: the cap counts from the probe's bucket."""
    s, p = _sides(stored, probes, key, ms, order)
    s = s.withColumn("s_b", bucket_of(F.col(f"s_{ms}"), t0, slide))
    if dedup:
        same = ["key", "s_b", *[c for c in s.columns if c not in ("key", "s_b", f"s_{ms}", f"s_{order}")]]
        first = s.groupBy(*same).agg(F.min(F.struct(f"s_{order}", f"s_{ms}")).alias("_first"))
        s = first.select(*same, F.col(f"_first.s_{order}"), F.col(f"_first.s_{ms}"))
    own = bucket_of(F.col(f"p_{ms}"), t0, slide)
    alive = F.floor((F.col(f"p_{ms}") - F.lit(t0 + window)) / F.lit(slide + 1)).cast("long") + 1
    p = p.withColumn("_hi", own).withColumn("_lo", F.greatest(alive, F.col("_hi") - (cap - 1)))
    out = banded_join(s, p, "key", "s_b", "_lo", "_hi", cap + 1, F.col(f"s_{order}") < F.col(f"p_{order}"))
    return out.drop("_lo", "_hi", "s_b")


def sliding_theta_join(stored: DataFrame, probes: DataFrame, op: str, value: str, ms: str, order: str, window: int, slide: int, t0: int | None = None) -> DataFrame:
    """``stored.value OP probe.value`` on whole numbers over a sliding window; the block of time is the only equality."""
    if op not in ("lt", "le", "gt", "ge"):
        raise ValueError(f"no such comparison: {op}")
    cap = check_window(window, slide)
    if t0 is None:
        t0 = stored.agg(F.min(ms)).first()[0] or 0
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    s, p = name(stored, "s").withColumn("s_b", bucket_of(F.col(f"s_{ms}"), t0, slide)), name(probes, "p")
    alive = F.floor((F.col(f"p_{ms}") - F.lit(t0 + window)) / F.lit(slide + 1)).cast("long") + 1
    lo = alive
    if cap * (slide + 1) < window:
        both = s.select(F.col(f"s_{order}").alias("_o"), F.col("s_b").alias("_b")).union(p.select(F.col(f"p_{order}"), F.lit(None).cast("long")))
        seen = running(both, "_o", {"_newest": ("max", F.col("_b"))})[0].filter("_b is null").select("_o", "_newest")
        p = p.join(seen, p[f"p_{order}"] == seen["_o"]).drop("_o", "_b")
        lo = F.greatest(alive, F.col("_newest") - (cap - 1))
    p = p.withColumn("_hi", bucket_of(F.col(f"p_{ms}"), t0, slide)).withColumn("_lo", lo)
    a, b = F.col(f"s_{value}").try_cast("bigint"), F.col(f"p_{value}").try_cast("bigint")
    out = banded_join(s, p, None, "s_b", "_lo", "_hi", window // (slide + 1) + 2, (F.col(f"s_{order}") < F.col(f"p_{order}")) & COMPARISONS[op](a, b))
    return out.select(*[c for c in out.columns if c not in ("_lo", "_hi", "s_b", "_newest")])


def count_window_join(left: DataFrame, right: DataFrame, key: str, order: str, size: int, normal: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Symmetric join over the last ``size`` rows of each side; a row probes the other side before it is stored.

    Columns: key (normalised), l_*, r_*.
    """
    if size < 1:
        raise ValueError("the window must hold at least one row")
    # both sides are numbered in one pass that carries their columns, so nothing is joined back
    tag = lambda df, side, p: df.select(normal(F.col(key)).alias("key"), F.col(order).alias("_o"), F.lit(side).alias("_side"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
    both = tag(left, 0, "l").unionByName(tag(right, 1, "r"), allowMissingColumns=True)
    both, _ = running(both, "_o", {"_nl": ("sum", (F.col("_side") == 0).cast("long")), "_nr": ("sum", (F.col("_side") == 1).cast("long"))})
    pick = lambda side, p: both.filter(F.col("_side") == side).select("key", "_nl", "_nr", *[c for c in both.columns if c.startswith(f"{p}_")])
    l, r = pick(0, "l"), pick(1, "r")

    def one(stored, probes, own, other):
        s = stored.withColumn("_pos", F.col(own)).drop("_nl", "_nr")
        p = probes.withColumn("_hi", F.col(own)).withColumn("_lo", F.col(own) - (size - 1)).drop("_nl", "_nr")
        return banded_join(s, p, "key", "_pos", "_lo", "_hi", size).drop("_pos", "_lo", "_hi")

    columns = ["key", *[f"l_{c}" for c in left.columns if c != key], *[f"r_{c}" for c in right.columns if c != key]]
    return one(l, r, "_nl", "_nr").select(*columns).unionByName(one(r, l, "_nr", "_nl").select(*columns))


def self_count_join(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Each row meets the retained rows before it with its key: key, a_order (older), b_order."""
    seq, _ = running(df.select(key, order), order, {"_seq": ("count", F.lit(1))})
    a = seq.select(F.col(key).alias("key"), F.col(order).alias("a_order"), F.col("_seq").alias("_pos"))
    b = seq.select(F.col(key).alias("key"), F.col(order).alias("b_order"), (F.col("_seq") - size).alias("_lo"), (F.col("_seq") - 1).alias("_hi"))
    return banded_join(a, b, "key", "_pos", "_lo", "_hi", size).select("key", "a_order", "b_order")


def stream_self_join(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """A stream on both sides of the count-window join: both orientations and one self pair.

    Row y meets x of the last ``size`` rows as (y, x), then, being stored, as (x, y) with itself among them.
    """
    seq, _ = running(df.select(key, order), order, {"_seq": ("count", F.lit(1))})
    x = seq.select(F.col(key).alias("key"), F.col(order).alias("x"), F.col("_seq").alias("_pos"))
    y = lambda first, last: seq.select(F.col(key).alias("key"), F.col(order).alias("y"), (F.col("_seq") + first).alias("_lo"), (F.col("_seq") + last).alias("_hi"))
    before = banded_join(x, y(-size, -1), "key", "_pos", "_lo", "_hi", size).select("key", F.col("y").alias("l_order"), F.col("x").alias("r_order"))
    after = banded_join(x, y(-size + 1, 0), "key", "_pos", "_lo", "_hi", size).select("key", F.col("x").alias("l_order"), F.col("y").alias("r_order"))
    return before.unionByName(after)


def ordered_columns(left_name: str, left: list[str], right_name: str, right: list[str]) -> list[str]:
    """The output order rule: columns of the relation whose name sorts first come first."""
    return [*left, *right] if left_name <= right_name else [*right, *left]
