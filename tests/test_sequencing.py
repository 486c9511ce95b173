"""Running totals and last rows over buckets, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import metrics, sequencing


def samples(n=400, seed=3):
    rng = random.Random(seed)
    # a key with most of the rows, a null key, ties and nulls among the values
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(9)]), rng.randint(0, 40)) for i in range(n)]


DDL = "id bigint, k string, v bigint, t bigint"


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_running_and_keyed_running(spark, buckets):
    data = samples()
    df = spark.createDataFrame(data, DDL)
    out, whole = sequencing.running(df, "id", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, buckets)
    want, s, m = [], 0, None
    for i, _, v, _ in data:
        if v is not None:
            s, m = s + v, v if m is None else max(m, v)
        want.append((i, i + 1, s, m))
    assert sorted(tuple(r) for r in out.select("id", "n", "s", "m").collect()) == want and whole == {"n": 400, "s": s, "m": m}
    got = {r.id: (r.n, r.s) for r in sequencing.keyed_running(df, ["k"], "id", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, buckets).collect()}
    sums = {}
    for i, k, v, _ in data:
        n, s = sums.get(k, (0, 0))
        sums[k] = (n + 1, s + (v or 0))
        assert got[i] == sums[k]


@pytest.mark.parametrize("buckets,n", [(1, 1), (7, 1), (60, 4), (300, 3)])
def test_last_rows_cross_bucket_borders(spark, buckets, n):
    data = samples()
    got = {r.id: [x["v0"] for x in r._before] for r in sequencing.lagged(spark.createDataFrame(data, DDL), ["k"], ["t", "id"], ["id"], n, buckets).collect()}
    seen = {}
    for i, k, _, _ in sorted(data, key=lambda r: (r[3], r[0])):
        before = seen.setdefault(k, [])
        assert got[i] == before[-n:]
        before.append(i)


def test_ties_are_ordered(spark):
    df = spark.createDataFrame([(i // 5, i) for i in range(100)], "o bigint, x bigint")
    got, n = sequencing.with_sequence(df, "o", "seq", ["x"])
    assert n == 100 and all(r.seq == r.x + 1 for r in got.collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], DDL)
    assert sequencing.running(df, "id", {"n": ("count", F.lit(1))})[1] == {"n": 0}
    assert sequencing.keyed_running(df, ["k"], "id", {"n": ("count", F.lit(1))}).collect() == []
    assert sequencing.lagged(df, ["k"], ["id"], ["v"]).collect() == []
    assert metrics.latency_summary(df, "k", "v").collect() == []


def test_percentiles_of_nulls_and_singles(spark):
    rows = [("a", None), ("b", 7), ("c", 1), ("c", 2), ("c", None), (None, 5)]
    got = {r.k: (r.p25, r.p50, r.p99, r.low) for r in metrics.latency_summary(spark.createDataFrame(rows, "k string, v bigint"), "k", "v").collect()}
    assert got == {"a": (None, None, None, None), "b": (7.0, 7.0, 7.0, 7), "c": (1.25, 1.5, 1.99, 1), None: (5.0, 5.0, 5.0, 5)}
