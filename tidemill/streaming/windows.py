"""Event-time windows on streams: joins and counts that Spark's own state handles.

Inputs carry ``ts`` (TIMESTAMP) and ``ms``; :func:`event_time` makes both from a
zoneless timestamp.  Late rows beyond the watermark's delay are dropped by Spark.
The buckets' origin ``t0`` must be given, since a stream's first row is not known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import COMPARISONS
from ..operators.sequencing import bucket_of, check_window, utc_timestamp
from ..operators.window_join import SHARES


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """df with a watermarked TIMESTAMP ``ts`` and its epoch milliseconds ``ms``."""
    out = df.withColumn("_ts", utc_timestamp(F.col(column))).drop(column).withColumnRenamed("_ts", "ts")
    return out.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)


def _pair(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for df, p in ((left, "l"), (right, "r")))


def symmetric_sliding_join(left: DataFrame, right: DataFrame, key: str, order: str, window: int, slide: int, t0: int) -> DataFrame:
    """As the batch join: the earlier row's bucket must be alive at the later one.

    The interval condition on event time lets Spark drop state behind the watermark.
    """
    cap = check_window(window, slide)
    l, r = _pair(left, right)
    lb, rb = bucket_of(F.col("l_ms"), t0, slide), bucket_of(F.col("r_ms"), t0, slide)
    alive = lambda b, ms: (b * (slide + 1) + (t0 + window)) > ms
    lefts_first = (F.col(f"l_{order}") < F.col(f"r_{order}")) & alive(lb, F.col("r_ms")) & (rb - lb < cap)
    rights_first = (F.col(f"r_{order}") < F.col(f"l_{order}")) & alive(rb, F.col("l_ms")) & (lb - rb < cap)
    span = F.make_dt_interval(secs=F.lit(window / 1000))
    bounded = (F.col("r_ts") >= F.col("l_ts") - span) & (F.col("r_ts") <= F.col("l_ts") + span)
    return l.join(r, (F.col(f"l_{key}") == F.col(f"r_{key}")) & bounded & (lefts_first | rights_first))


def sliding_equi_join(stored: DataFrame, probes: DataFrame, key: str, order: str, window: int, slide: int, t0: int) -> DataFrame:
    """One-sided, as the batch join: each probe (r_*) meets the stored rows (l_*) that arrived before it and are alive.

    A ring that ends before the window does (``window // slide`` closed buckets shorter than the
    window) drops rows by the newest stored bucket, which a join's state does not know; such windows are refused.
    """
    if check_window(window, slide) * (slide + 1) < window:
        raise ValueError("on a stream the ring of buckets must span the window")
    l, r = _pair(stored, probes)
    alive = bucket_of(F.col("l_ms"), t0, slide) * (slide + 1) + (t0 + window) > F.col("r_ms")
    span = F.make_dt_interval(secs=F.lit(window / 1000))
    bounded = (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + span)
    return l.join(r, (F.col(f"l_{key}") == F.col(f"r_{key}")) & bounded & (F.col(f"l_{order}") < F.col(f"r_{order}")) & alive)


def sliding_theta_join(stored: DataFrame, probes: DataFrame, op: str, value: str, order: str, window: int, slide: int, t0: int) -> DataFrame:
    """Spark has no stream join without equality: probes carry the number of their ``window``-long block, stored rows two.

    A block's stored rows are dealt out to SHARES and each probe goes to all of them.
    """
    check_window(window, slide)
    s, p = _pair(stored, probes)
    s = s.withColumn("l_share", F.pmod(F.xxhash64(f"l_{order}"), F.lit(SHARES)).cast("int"))
    p = p.withColumn("r_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    s = s.withColumn("l_block", F.explode(F.array(F.floor(F.col("l_ms") / window), F.floor(F.col("l_ms") / window) + 1)))
    p = p.withColumn("r_block", F.floor(F.col("r_ms") / window))
    b = bucket_of(F.col("l_ms"), t0, slide)
    span = F.make_dt_interval(secs=F.lit(window / 1000))
    bounded = (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + span)
    alive = (b * (slide + 1) + (t0 + window)) > F.col("r_ms")
    test = COMPARISONS[op](F.col(f"l_{value}").cast("bigint"), F.col(f"r_{value}").cast("bigint"))
    same = (F.col("l_block") == F.col("r_block")) & (F.col("l_share") == F.col("r_share"))
    return s.join(p, same & bounded & alive & (F.col(f"l_{order}") < F.col(f"r_{order}")) & test).drop("l_block", "r_block", "l_share", "r_share")


def hopping_group_count(df: DataFrame, key: str, window: int, slide: int, name: str = "n") -> DataFrame:
    """Counts by key and window; a window is final when the watermark has passed it."""
    w = F.window("ts", f"{window} milliseconds", f"{slide} milliseconds")
    return df.groupBy(w.alias("_w"), key).agg(F.count("*").alias(name)).select(key, F.unix_millis("_w.start").alias("window_start"), name)


def group_running_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Totals by key so far (update mode)."""
    return df.groupBy(F.lower(F.col(key)).alias(key)).agg(F.count("*").alias(name))
