"""Arrival order and time buckets, without a global single-partition sort.

``running`` cuts the rows into buckets of the order column at approximate
quantiles, aggregates each bucket, adds up the bucket totals and runs the window
inside each bucket.  So a running count, sum or maximum over any number of rows is a
bounded sort per task.  ``keyed_running`` and ``lagged`` do the same for the rows of
each key, whose buckets' totals or last rows are carried over, so a hot key is many
tasks'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should have, buckets whose bounds fit an expression, and most buckets.
BUCKET_ROWS, COARSE, MAX_BUCKETS = 1 << 22, 256, 1 << 16


def millis(ts: str | Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC, or of a TIMESTAMP."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(utc_timestamp(c))


def utc_timestamp(c: Column) -> Column:
    """A TIMESTAMP (as watermarks need it) from a zoneless one that means UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp")


def _bucket(order: Column, bounds: list) -> Column:
    """The number of bounds below the value, by binary decisions."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order <= F.lit(bounds[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(bounds))


def bucketed(df: DataFrame, order: str | Column, buckets: int | None = None, name: str = "_bucket") -> DataFrame:
    """df with the number of the quantile bucket of a numeric column; as many buckets as the rows need."""
    order = F.col(order) if isinstance(order, str) else order
    if buckets is None:
        buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    n = min(MAX_BUCKETS, buckets)
    cuts = [k / n for k in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(order, cuts, max(10_000, 8 * n))).first()[0] or [])) if cuts else []
    if len(bounds) < COARSE:
        return df.withColumn(name, _bucket(order, bounds))
    # two steps: bounds of groups in an expression, the others from a table of at most MAX_BUCKETS numbers
    step = -(-len(bounds) // COARSE)
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    table = df.sparkSession.createDataFrame([(k, k * step, g[:-1]) for k, g in enumerate(groups)] + [(len(groups), len(bounds), [])], f"_group int, _first int, _bounds array<{df.select(order.alias('o')).dtypes[0][1]}>")
    near = df.withColumn("_group", _bucket(order, [g[-1] for g in groups])).join(F.broadcast(table), "_group")
    return near.withColumn(name, F.col("_first") + F.size(F.filter("_bounds", lambda b: b < order))).drop("_group", "_first", "_bounds")


_AGGREGATES = {"count": F.count, "sum": F.sum, "max": F.max}


def running(df: DataFrame, order: str, totals: dict[str, tuple[str, Column]], buckets: int | None = None, ties: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """(df with running totals over ``order``, overall totals).

    ``totals``: name -> ("count" | "sum" | "max", column).  ``order`` must be numeric and, with the columns of ``ties``, unique.
    """
    b = bucketed(df, order, buckets)
    # one row for each of at most MAX_BUCKETS buckets
    per = {r["_bucket"]: r for r in b.groupBy("_bucket").agg(*[_AGGREGATES[k](c).alias(name) for name, (k, c) in totals.items()]).collect()}
    whole = {name: None if k == "max" else 0 for name, (k, _) in totals.items()}
    before = []
    for i in sorted(per):
        before.append((i, *whole.values()))
        for name, (k, _) in totals.items():
            value = per[i][name]
            if value is not None:
                whole[name] = value if whole[name] is None else max(whole[name], value) if k == "max" else whole[name] + value
    w = Window.partitionBy("_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b
    if len(before) <= COARSE:
        offset = {name: F.element_at(F.map_from_arrays(F.array(*[F.lit(r[0]) for r in before]), F.array(*[F.lit(r[1 + j]) for r in before])), F.col("_bucket")) for j, name in enumerate(totals)} if before else {name: F.lit(None).cast("long") for name in totals}
    else:
        kinds = dict(b.select(*[_AGGREGATES[k](c).over(w).alias(name) for name, (k, c) in totals.items()]).dtypes)
        table = df.sparkSession.createDataFrame(before, "_bucket int, " + ", ".join(f"`_before_{name}` {kinds[name]}" for name in totals))
        out = out.join(F.broadcast(table), "_bucket")
        offset = {name: F.col(f"_before_{name}") for name in totals}
    for name, (k, c) in totals.items():
        local = _AGGREGATES[k](c).over(w)
        out = out.withColumn(name, F.greatest(local, offset[name]) if k == "max" else F.coalesce(local, F.lit(0)) + offset[name])
    return out.drop("_bucket", *[f"_before_{name}" for name in totals]), whole


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    on = left["_bucket"] == right["_b_bucket"]
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(right[f"_b_{i}"])
    return on


def keyed_running(df: DataFrame, keys: Sequence[str], order: str, totals: dict[str, tuple[str, Column]], buckets: int | None = None) -> DataFrame:
    """df with running counts or sums of its key so far, the row included; ``order`` is numeric and unique within a key.

    A key's rows are spread over buckets; a table of a row for each key and bucket carries the totals before.
    """
    b = bucketed(df, order, buckets)
    per = b.groupBy(*keys, "_bucket").agg(*[_AGGREGATES[k](c).alias(name) for name, (k, c) in totals.items()])
    so_far = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*[F.col(k).alias(f"_b_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b_bucket"), *[F.coalesce(F.sum(name).over(so_far), F.lit(0)).alias(f"_before_{name}") for name in totals])
    w = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.coalesce(_AGGREGATES[k](c).over(w), F.lit(0)).alias(f"_local_{name}") for name, (k, c) in totals.items()])
    return local.join(before, _same(keys, local, before)).select(*[local[c] for c in df.columns], *[(F.col(f"_local_{name}") + F.col(f"_before_{name}")).alias(name) for name in totals])


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int = 1, buckets: int | None = None) -> DataFrame:
    """df with ``_before``: the values of ``columns`` in the key's last ``n`` rows before each row, oldest first.

    Rows are ordered by the columns of ``order``, the first of which is numeric and cut into
    buckets.  The last ``n`` rows of each key and bucket are carried into the key's next buckets.
    """
    b = bucketed(df, order[0], buckets)
    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    if n == 1:
        tails = b.groupBy(*keys, "_bucket").agg(F.array(F.max_by(row, F.struct(*order))).alias("_tail"))
    else:
        last = b.select(*keys, "_bucket", F.struct(F.struct(*order).alias("o"), row.alias("r")).alias("_r"), F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) for c in order])).alias("_k"))
        tails = last.filter(F.col("_k") <= n).groupBy(*keys, "_bucket").agg(F.transform(F.sort_array(F.collect_list("_r")), lambda x: x["r"]).alias("_tail"))
    # at most ``n`` values for each of a key's buckets; of all before, the last ``n`` count
    earlier = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-n, -1)))
    carried = tails.select(*[F.col(k).alias(f"_b_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b_bucket"), earlier.alias("_carried"))
    local = b.withColumn("_local", F.collect_list(row).over(inner.rowsBetween(-n, -1)))
    both = F.concat("_carried", "_local")
    out = local.join(carried, _same(keys, local, carried)).withColumn("_both", both)
    return out.select(*[local[c] for c in df.columns], F.slice("_both", F.greatest(F.size("_both") - (n - 1), F.lit(1)), n).alias("_before"))


def with_sequence(df: DataFrame, order: str, name: str = "seq", ties: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(df with 1-based arrival numbers, number of rows)."""
    out, whole = running(df, order, {name: ("count", F.lit(1))}, ties=ties)
    return out, whole[name]


def check_window(window: int, slide: int) -> int:
    """Buckets that a sliding window holds; windows must span at least two slides."""
    if slide < 1 or window < 2 * slide:
        raise ValueError("the window must be at least two slides long")
    return window // slide


def bucket_of(ms: Column, t0: int, slide: int) -> Column:
    """Number of the closed bucket of ``slide`` + 1 ms, counted from ``t0``."""
    return F.floor((ms - F.lit(t0)) / F.lit(slide + 1)).cast("long")


def block_number(seq: Column, size: int) -> Column:
    """0-based number of the block of ``size`` rows."""
    return F.floor((seq - 1) / F.lit(size)).cast("long")
