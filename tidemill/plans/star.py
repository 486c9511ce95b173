"""Multi-way joins over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequencing import with_sequence
from ..operators.window_join import symmetric_sliding_join
from ..schemas import STAR_COLUMNS
from ..sources.readers import arrival_ms, parquet

#: Rows a second of each paced source, and the windows of the joins in ms.
RATE, WINDOW, SLIDE = 1000, 12_000, 2_000


def order_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"])
    orders = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"])


def star_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer ⋈ orders) ⋈ (lineitem ⋈ supplier).  Catalyst and AQE choose the order and the algorithms."""
    c, o, li, s = (parquet(spark, sf_dir, t, STAR_COLUMNS[t]) for t in ("customer", "orders", "lineitem", "supplier"))
    left = c.join(o, c["c_custkey"] == o["o_custkey"])
    right = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    return left.join(right, left["o_orderkey"] == right["l_orderkey"])


def local_revenue(spark: SparkSession, sf_dir: str, region: str = "ASIA") -> DataFrame:
    """Revenue in 1/10000 by nation where customer and supplier share it (an extension of the join core)."""
    return _revenue(spark, sf_dir, star_core(spark, sf_dir), region)


def _revenue(spark: SparkSession, sf_dir: str, core: DataFrame, region: str) -> DataFrame:
    n, r = (parquet(spark, sf_dir, t) for t in ("nation", "region"))
    here = n.join(r.filter(F.col("r_name") == region), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name")
    core = core.filter("c_nationkey = s_nationkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.round((1 - F.col("l_discount")) * 100).cast("bigint")
    return core.join(here, core["s_nationkey"] == here["n_nationkey"]).groupBy("n_name").agg(F.sum(cents).alias("revenue_e4"))


#: What tells apart lineitems of one order.
LINE_TIES = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]


def paced(df: DataFrame, order: str, source: int, sources: int = 4, rate: int = RATE, ties: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """df with its rows' arrival time ``ms`` at ``rate`` rows a second and an ``arrival`` number over all sources, which run side by side."""
    numbered, _ = with_sequence(df, order, "_seq", ties)
    ms = F.floor(arrival_ms(F.col("_seq"), [rate], [0])).cast("long")
    return numbered.select(*df.columns, ms.alias("ms"), (F.col("_seq") * sources + source).alias("arrival"))


def windowed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, slide: int) -> DataFrame:
    """A symmetric sliding-window join of paced relations; a pair arrives with its later row."""
    names = [c for c in (*left.columns, *right.columns) if c not in ("ms", "arrival")]
    side = lambda df, key: df.select(F.col(key).alias("_key"), *df.columns)
    pairs = symmetric_sliding_join(side(left, left_key), side(right, right_key), "_key", "ms", "arrival", window, slide)
    both = [F.greatest(f"l_{c}", f"r_{c}").alias(c) for c in ("ms", "arrival")]
    return pairs.select(*[F.col(f"l_{c}" if c in left.columns else f"r_{c}").alias(c) for c in names], *both)


def order_lineitem_windowed(spark: SparkSession, sf_dir: str, window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """Orders and lineitems that arrive within a sliding window of each other."""
    orders = paced(parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), "o_orderkey", 0, 2)
    line = paced(parquet(spark, sf_dir, "lineitem", ["l_orderkey", *LINE_TIES]), "l_orderkey", 1, 2, ties=LINE_TIES)
    return windowed(orders, line.drop("l_partkey", "l_extendedprice"), "o_orderkey", "l_orderkey", window, slide)


def star_core_windowed(spark: SparkSession, sf_dir: str, window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """The star join core with a sliding window at each join, over four sources that run side by side."""
    c, o, li, s = (parquet(spark, sf_dir, t, STAR_COLUMNS[t] + (["l_linenumber", "l_partkey"] if t == "lineitem" else [])) for t in ("customer", "orders", "lineitem", "supplier"))
    left = windowed(paced(c, "c_custkey", 0), paced(o, "o_orderkey", 1), "c_custkey", "o_custkey", window, slide)
    right = windowed(paced(li, "l_orderkey", 2, ties=LINE_TIES).drop("l_partkey"), paced(s, "s_suppkey", 3), "l_suppkey", "s_suppkey", window, slide)
    return windowed(left, right, "o_orderkey", "l_orderkey", window, slide)


def local_revenue_windowed(spark: SparkSession, sf_dir: str, region: str = "ASIA", window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """Revenue by nation of the windowed core, where customer and supplier share the nation."""
    return _revenue(spark, sf_dir, star_core_windowed(spark, sf_dir, window, slide), region)
