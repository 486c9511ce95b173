"""Deterministic generators: balanced and skewed key streams, words, cyclic expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("ada", "bela", "cora", "dino", "emil", "faye", "gus", "hugo", "ines")


def balanced(spark: SparkSession, rows: int, keys: int) -> DataFrame:
    """key (1 .. keys, in turn) and a running counter."""
    return spark.range(rows).select((F.col("id") % keys + 1).cast("string").alias("key"), (F.col("id") + 1).alias("cnt"))


def phases(spark: SparkSession, rows: int, shares: Sequence[float] = (0.95, 0.5, 0.05, 0.5)) -> DataFrame:
    """Keys 1 and 2; phase i has ``rows`` rows of which ``shares[i]`` have key 1, spread evenly."""
    n = len(shares)
    base = spark.range(rows * n).select("id", F.floor(F.col("id") / rows).cast("int").alias("phase"), (F.col("id") % rows).alias("k"))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("phase") + 1)
    first = F.floor((F.col("k") + 1) * share) > F.floor(F.col("k") * share)
    return base.select("id", "phase", F.when(first, "1").otherwise("2").alias("key"))


def named(spark: SparkSession, rows: int, words: Sequence[str] = NAMES) -> DataFrame:
    """num 0 and names in turn."""
    return spark.range(rows).select(F.lit(0).alias("num"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int")).alias("name"))


def word_stream(spark: SparkSession, rows_per_second: int, words: Sequence[str] = NAMES) -> DataFrame:
    """A stream of timestamped words."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    pick = (F.pmod(F.xxhash64("value"), F.lit(len(words))) + 1).cast("int")
    return rate.select("timestamp", F.element_at(F.array(*map(F.lit, words)), pick).alias("word"))


def expand(df: DataFrame, order: str, factor: float) -> DataFrame:
    """The rows in turn until there are ceil(n * factor), numbered by ``copy_id`` from 0.

    Every row knows how often it occurs, so it is exploded in place.
    """
    from ..operators.sequencing import with_sequence

    numbered, n = with_sequence(df, order, "_seq")
    total = -(-int(round(n * factor * 1_000_000)) // 1_000_000)
    if not n:
        return df.withColumn("copy_id", F.lit(0).cast("long"))
    times = F.floor((F.lit(total) - F.col("_seq")) / F.lit(n)) + 1
    copies = numbered.filter(F.col("_seq") <= total).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1)))
    return copies.withColumn("copy_id", F.col("_k") * n + F.col("_seq") - 1).drop("_k", "_seq")
