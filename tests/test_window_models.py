"""Declarative windowed joins and counts against small ring-buffer models."""

import random

import pytest

from tidemill.operators import aggregates, window_join
from tidemill.operators.sequencing import check_window, running, with_sequence
from pyspark.sql import functions as F


def trace(seed, n, gap, keys=3):
    """(order, ms, key, side) rows with ties and gaps of at most ``gap`` ms."""
    rng, ms, out = random.Random(seed), 1000, []
    for i in range(n):
        ms += rng.randint(0, gap)
        out.append((i, ms, rng.randint(1, keys), rng.choice("lr")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, ms bigint, k int, side string")


class Ring:
    """Gap-free buckets of slide + 1 ms, newest first, at most ``window // slide`` of them."""

    def __init__(self, window, slide, t0):
        self.window, self.slide, self.t0, self.buckets = window, slide, t0, {}

    def number(self, ms):
        return (ms - self.t0) // (self.slide + 1)

    def roll(self, ms):
        newest = self.number(ms)
        self.buckets = {b: r for b, r in self.buckets.items() if newest - b < self.window // self.slide}

    def store(self, ms, row):
        self.roll(ms)
        self.buckets.setdefault(self.number(ms), []).append(row)

    def alive(self, ms):
        return [r for b, rows in self.buckets.items() if self.t0 + b * (self.slide + 1) + self.window > ms for r in rows]


@pytest.mark.parametrize("seed,window,slide", [(1, 100, 10), (2, 100, 30), (3, 60, 20)])
def test_one_sided_join(spark, rows, seed, window, slide):
    data = trace(seed, 250, 9)
    t0 = min(r[1] for r in data if r[3] == "l")
    ring, expected = Ring(window, slide, t0), []
    for i, ms, k, side in data:
        if side == "l":
            ring.store(ms, (i, k))
        else:
            expected += [(k, s, i) for s, sk in ring.alive(ms) if sk == k]
    df = frame(spark, data)
    got = window_join.sliding_equi_join(df.filter("side = 'l'"), df.filter("side = 'r'"), "k", "ms", "id", window, slide)
    assert rows(got, "key", "s_id", "p_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("seed,window,slide", [(4, 100, 10), (5, 100, 30)])
def test_symmetric_join(spark, rows, seed, window, slide):
    data = trace(seed, 250, 9)
    rings = {s: Ring(window, slide, data[0][1]) for s in "lr"}
    expected = []
    for i, ms, k, side in data:
        for ring in rings.values():
            ring.roll(ms)
        rings[side].store(ms, (i, k))
        expected += [(k, i, o) if side == "l" else (k, o, i) for o, ok in rings["r" if side == "l" else "l"].alive(ms) if ok == k]
    df = frame(spark, data)
    got = window_join.symmetric_sliding_join(df.filter("side = 'l'"), df.filter("side = 'r'"), "k", "ms", "id", window, slide)
    assert rows(got, "key", "l_id", "r_id") == sorted(expected, key=repr)


def test_dedup_keeps_the_first_of_equal_rows(spark, rows):
    data = [(0, 0, 1, "l"), (1, 1, 1, "l"), (2, 40, 1, "l"), (3, 41, 1, "r")]
    df = frame(spark, data)
    got = window_join.sliding_equi_join(df.filter("side = 'l'"), df.filter("side = 'r'"), "k", "ms", "id", 100, 10, dedup=True)
    assert rows(got, "s_id", "p_id") == [(0, 3), (2, 3)]


@pytest.mark.parametrize("op", ["lt", "le", "gt", "ge"])
def test_theta_join(spark, rows, op):
    import operator

    data = trace(6, 200, 9, keys=9)
    t0 = min(r[1] for r in data if r[3] == "l")
    ring, expected = Ring(100, 10, t0), []
    for i, ms, k, side in data:
        if side == "l":
            ring.store(ms, (i, k))
        else:
            expected += [(s, i) for s, sk in ring.alive(ms) if getattr(operator, op)(sk, k)]
    df = frame(spark, data)
    got = window_join.sliding_theta_join(df.filter("side = 'l'"), df.filter("side = 'r'"), op, "k", "ms", "id", 100, 10)
    assert rows(got, "s_id", "p_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("size", [1, 7, 500])
def test_count_window_join(spark, rows, size):
    data = trace(7, 200, 5)
    held, expected = {"l": [], "r": []}, []
    for i, _, k, side in data:
        expected += [(k, i, o) if side == "l" else (k, o, i) for o, ok in held["r" if side == "l" else "l"] if ok == k]
        held[side] = [*held[side], (i, k)][-size:]
    df = frame(spark, data).select("id", "k", "side")
    got = window_join.count_window_join(df.filter("side = 'l'").drop("side"), df.filter("side = 'r'").drop("side"), "k", "id", size)
    assert rows(got, "key", "l_id", "r_id") == sorted(expected, key=repr)


def test_self_joins(spark, rows):
    data = trace(8, 150, 5)
    df, size = frame(spark, data), 9
    older, both, kept = [], [], []
    for i, _, k, _ in data:
        older += [(k, o, i) for o, ok in kept if ok == k]
        both += [(k, i, o) for o, ok in kept if ok == k]
        kept = [*kept, (i, k)][-size:]
        both += [(k, o, i) for o, ok in kept if ok == k]
    assert rows(window_join.self_count_join(df, "k", "id", size)) == sorted(older, key=repr)
    assert rows(window_join.stream_self_join(df, "k", "id", size)) == sorted(both, key=repr)


def test_sliding_group_count(spark, rows):
    data = trace(9, 250, 9)
    ring, expected = Ring(100, 30, data[0][1]), []
    for i, ms, k, _ in data:
        ring.store(ms, k)
        expected.append((i, sum(x == k for x in ring.alive(ms))))
    assert rows(aggregates.sliding_group_count(frame(spark, data), "k", "ms", "id", 100, 30), "id", "n") == sorted(expected, key=repr)


def test_group_running_count_ignores_case(spark, rows):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b"), (4, "A")], "id bigint, k string")
    assert rows(aggregates.group_running_count(df, ["k"], "id"), "id", "key", "n") == [(1, "A", 1), (2, "A", 2), (3, "b", 1), (4, "A", 3)]


def test_tumbling_blocks_are_complete(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, -5, 3, 3, 9])], "id bigint, v bigint")
    assert rows(aggregates.tumbling_sum(df, "id", 2, F.col("v"))) == [(0, -4), (1, 6)]
    assert rows(aggregates.tumbling_sum(df, "id", 2, F.col("v"), positive_only=True)) == [(1, 6)]
    assert rows(aggregates.tumbling_count_if(df, "id", 2, "v", "le", 3)) == [(0, 2), (1, 2)]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_running_totals_do_not_depend_on_buckets(spark, rows, buckets):
    data = [(i * 7 % 101, (i * 13) % 10 - 4) for i in range(101)]
    df = spark.createDataFrame(data, "id bigint, v bigint")
    got, whole = running(df, "id", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, buckets)
    expected, s, m = [], 0, None
    for n, (i, v) in enumerate(sorted(data), 1):
        s, m = s + v, v if m is None else max(m, v)
        expected.append((i, n, s, m))
    assert rows(got, "id", "n", "s", "m") == sorted(expected, key=repr)
    assert whole["n"] == 101


def test_empty_inputs(spark, rows):
    df = frame(spark, [])
    assert rows(window_join.symmetric_sliding_join(df, df, "k", "ms", "id", 100, 10)) == []
    assert rows(window_join.count_window_join(df.select("id", "k"), df.select("id", "k"), "k", "id", 5)) == []
    assert rows(aggregates.sliding_group_count(df, "k", "ms", "id", 100, 10)) == []
    assert with_sequence(df, "id")[1] == 0


def test_bad_arguments(spark):
    df = frame(spark, [(1, 1, 1, "l")])
    with pytest.raises(ValueError):
        check_window(59, 30)
    with pytest.raises(ValueError):
        window_join.sliding_equi_join(df, df, "nope", "ms", "id", 100, 10)
    with pytest.raises(ValueError):
        window_join.count_window_join(df, df, "k", "id", 0)
