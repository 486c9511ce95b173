"""Operational analytics over metric series: rolling means, rates, percentiles, disorder, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequencing import keyed_running, lagged


def _last(i: int) -> Column:
    """Column ``i`` of the row before; NULL for a key's first row."""
    return F.get("_before", F.lit(0))[f"v{i}"]


def rolling_mean(df: DataFrame, task: str, order: str, value: str, n: int, name: str = "mean") -> DataFrame:
    """Mean of the task's last ``n`` samples; those without a value do not count."""
    if n == 1:
        return df.withColumn(name, F.col(value).cast("double"))
    some = F.filter(F.concat(F.transform("_before", lambda x: x["v0"]), F.array(value)), lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0).cast(_sum_type(df, value)), lambda a, x: a + x)
    return lagged(df, [task], [order], [value], n - 1).withColumn(name, F.when(F.size(some) > 0, total / F.size(some))).drop("_before")


def _sum_type(df: DataFrame, value: str) -> str:
    return "bigint" if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"


def cumulative_mean(df: DataFrame, task: str, order: str, value: str, name: str = "mean") -> DataFrame:
    """Mean of the task's samples so far; NULL before the first value."""
    both = keyed_running(df, [task], order, {"_sum": ("sum", F.col(value)), "_count": ("count", F.col(value))})
    return both.withColumn(name, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).drop("_sum", "_count")


def slope(df: DataFrame, task: str, order: str, ms: str, value: str, name: str = "slope") -> DataFrame:
    """Absolute change since the last sample per ms; NULL without one or without time between."""
    dt = F.col(ms) - _last(0)
    return lagged(df, [task], [order], [ms, value]).withColumn(name, F.abs(F.col(value) - _last(1)) / F.when(dt != 0, dt)).drop("_before")


def rate(df: DataFrame, ms: str, every: int, by: tuple[str, ...] = (), name: str = "n") -> DataFrame:
    """Rows in each interval of ``every`` ms that has any."""
    start = (F.floor(F.col(ms) / F.lit(every)) * every).cast("long").alias("interval_start")
    return df.groupBy(*by, start).agg(F.count("*").alias(name))


def parse_metric_log(lines: DataFrame) -> DataFrame:
    """date-time, ts, supervisor:port, taskid:taskname, metric, value, tab-separated; other lines go."""
    p = F.split("value", "\t", -1)
    host, task = F.split(F.get(p, F.lit(2)), ":"), F.split(F.get(p, F.lit(3)), ":")
    rows = lines.filter(F.size(p) >= 6).select(
        F.get(p, F.lit(1)).try_cast("bigint").alias("ts"), F.get(host, F.lit(0)).alias("supervisor"), F.get(host, F.lit(1)).try_cast("int").alias("port"),
        F.get(task, F.lit(0)).alias("task_id"), F.get(task, F.lit(1)).alias("task"), F.get(p, F.lit(4)).alias("metric"), F.get(p, F.lit(5)).alias("value"),
    )
    return rows.filter("ts is not null")


#: Log line patterns by series.
SERIES_PATTERNS = {
    "input_rate": r"input-rate[=:]\s*([-0-9.eE+]+)",
    "latency": r"latency[=:]\s*([-0-9.eE+]+)",
    "control_interval": r"control-interval[=:]\s*([-0-9.eE+]+)",
    "state_size": r"state-size[=:]\s*([-0-9.eE+]+)",
    "throughput": r"throughput[=:]\s*([-0-9.eE+]+)",
}


def extract_series(lines: DataFrame) -> DataFrame:
    """series, value of free-text log lines, one row for each pattern that a line has."""
    found = F.array(*[F.struct(F.lit(k).alias("series"), F.regexp_extract("value", p, 1).try_cast("double").alias("value")) for k, p in SERIES_PATTERNS.items()])
    return lines.select(F.inline(F.filter(found, lambda x: x["value"].isNotNull())))


#: Fields of a line of operator statistics.
STATISTIC_FIELDS = ("cpu", "memory", "latency", "throughput", "selectivity", "plain", "det", "rnd", "ope", "hom")


def parse_statistics(lines: DataFrame, name: str = "value") -> DataFrame:
    """operator, the ten numbers of a ``cpu,memory,...`` line; lines with fewer fields or another text in one are dropped."""
    p = F.split(name, ",", -1)
    cells = [F.trim(F.get(p, F.lit(i))).try_cast("double").alias(f) for i, f in enumerate(STATISTIC_FIELDS)]
    whole = F.lit(True)
    for f in STATISTIC_FIELDS:
        whole = whole & F.col(f).isNotNull()
    return lines.select("operator", *cells).filter(whole)


def metric_avg(df: DataFrame, task: str, metric: str, value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(task, metric).agg(F.avg(value).alias(name))


def metric_series(df: DataFrame, by: list[str], order: str, name: str = "idx") -> DataFrame:
    """Samples numbered from 0 within each series."""
    return keyed_running(df, by, order, {name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)


def two_level_means(df: DataFrame, operator: Column, task: str, values: list[str]) -> DataFrame:
    """Means of the tasks' means by operator."""
    tasks = df.groupBy(operator.alias("operator"), F.col(task)).agg(*[F.avg(v).alias(v) for v in values])
    return tasks.groupBy("operator").agg(*[F.avg(v).alias(f"mean_{v}") for v in values], F.count("*").alias("tasks"))


def latency_summary(df: DataFrame, by: str, value: str, percents: tuple[int, ...] = (25, 50, 75, 90, 99)) -> DataFrame:
    """Mean, extremes and linearly interpolated percentiles (position p (n - 1) + 1).

    Exact: equal values are counted first, running counts over the counted values give ranks,
    and the values at the two ranks around each position are picked.  No task holds a group.
    """
    known = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = keyed_running(known, [by], "_v", {"_upto": ("sum", F.col("_n"))})
    whole = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("_all"))
    at = {p: F.lit(p / 100) * (F.col("_all") - 1) for p in percents}
    pick = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v").cast("double")))
    cells = [c for p in percents for c in (pick(F.floor(at[p])).alias(f"_a{p}"), pick(F.ceil(at[p])).alias(f"_b{p}"))]
    around = ranked.join(whole.select("_by", "_all"), F.col(by).eqNullSafe(F.col("_by"))).groupBy("_by").agg(*cells).withColumnRenamed("_by", "_same")
    mixed = [(F.col(f"_a{p}") + (F.col(f"_b{p}") - F.col(f"_a{p}")) * (at[p] - F.floor(at[p]))).alias(f"p{p}") for p in percents]
    return whole.join(around, F.col("_by").eqNullSafe(F.col("_same")), "left").select(F.col("_by").alias(by), "mean", "low", "high", *mixed)


def close_pairs(df: DataFrame, first: str, second: str, within: int = 1000, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(F.abs(F.col(second) - F.col(first)) < within).alias(name))


def close_neighbours(df: DataFrame, by: str, order: str, ms: str, within: int = 1000, name: str = "n") -> DataFrame:
    """Rows less than ``within`` ms from the row before of their key."""
    pairs = lagged(df.select(by, order, ms), [by], [order], [ms]).select(F.col(ms).alias("_ms"), _last(0).alias("_last"))
    return close_pairs(pairs, "_ms", "_last", within, name)


def disorder(df: DataFrame, by: str, order: str | list[str], ms: str, limit: int = 1000) -> DataFrame:
    """Rows that are earlier than the one before, and gaps below or above ``limit`` ms."""
    order = [order] if isinstance(order, str) else order
    g = lagged(df, [by], order, [ms]).select(by, (F.col(ms) - _last(0)).alias("_gap"))
    return g.groupBy(by).agg(F.count_if(F.col("_gap") < 0).alias("backwards"), F.count_if(F.abs("_gap") < limit).alias("within"), F.count_if(F.abs("_gap") >= limit).alias("beyond"))


def clock_free_latency(df: DataFrame, link: str, order: str, local: str, remote: str, name: str = "latency") -> DataFrame:
    """Mean difference between gaps of two clocks: the clocks' offset cancels out."""
    gaps = lagged(df, [link], [order], [local, remote]).select(link, F.abs((F.col(local) - _last(0)) - (F.col(remote) - _last(1))).alias("_d"))
    return gaps.groupBy(link).agg(F.avg("_d").alias(name))


def tick_latency(df: DataFrame, task: str, order: str, ms: str, period: int, name: str = "latency") -> DataFrame:
    return lagged(df, [task], [order], [ms]).withColumn(name, F.col(ms) - _last(0) - period).drop("_before")


def replay(statistics: DataFrame, events: DataFrame, ts: str) -> DataFrame:
    """Two event tables merged by time; columns that one lacks are NULL."""
    return statistics.unionByName(events, allowMissingColumns=True).orderBy(ts)


def key_load(df: DataFrame, key: str, tasks: int, name: str = "n") -> DataFrame:
    """Rows and keys that each of ``tasks`` owners of a whole-number key would get."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.groupBy(F.pmod(F.col(key), F.lit(tasks)).cast("long").alias("task")).agg(F.sum("_n").alias(name), F.count("*").alias("keys"))
