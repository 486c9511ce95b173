"""Near-duplicates against all pairs; registers and estimates."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import neardup as n

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k=4):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


def groups(seed, sizes, words=60):
    """Groups of texts, each a copy of a base with a few words changed."""
    rng = random.Random(seed)
    out = []
    for g, size in enumerate(sizes):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, words))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out, 10))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id bigint, text string, n string")
    return sorted(map(tuple, n.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4)])
def test_components_equal_all_pairs(spark, seed, block):
    rows = groups(seed, [1, 1, 2, 3, 5, 40, 80], words=120 if seed == 1 else 60)
    rows += [(1, ""), (2, None), (3, "one"), (4, "ONE"), (5, "one two three"), (6, " \t"), (7, rows[0][1]), (8, rows[0][1])]
    assert run(spark, rows, block=block) == sorted(brute(rows), key=repr)


def test_chain_of_links(spark):
    words = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60])) for i in range(9)]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_empty_null_and_repeated_ids(spark):
    assert run(spark, []) == []
    t = "a b c d e f"
    assert run(spark, [(1, t), (1, t), (None, t), (2, "z")]) == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, True), (2, 1, 2, True)], key=repr)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for j in (0.0, 0.3, 0.8, 1.0):
        got = []
        for _ in range(20):
            shared, a, b = (rng.integers(0, 1 << 63, m, dtype=np.uint64) for m in (int(300 * j), int(150 * (1 - j)), int(150 * (1 - j))))
            x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
            r = n.registers(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            got.append(n.estimate(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0])
        assert abs(np.mean(got) - len(shared) / max(1, len(shared) + len(a) + len(b))) < 0.03


def test_margin_costs_less_than_buckets():
    size = np.array([1000])
    a = np.zeros((1, n.REGISTERS), np.uint16)
    lost = 0.0
    for same in range(n.REGISTERS + 1):
        b = (np.arange(n.REGISTERS) >= same).astype(np.uint16)[None, :]
        if not n.likely(n.estimate(a, b, size, size), size, size, n.THRESHOLD)[0]:
            lost += math.comb(n.REGISTERS, same) * 0.8**same * 0.2 ** (n.REGISTERS - same)
    assert lost < 1e-7


def test_shingle_sets():
    t = ["A b c d E", "a b", "", "x x x x x x"]
    flat, off = n.shingle_sets(pa.array(t, pa.large_string()), 4)
    assert np.diff(off).tolist() == [2, 1, 0, 1]
    again, _ = n.shingle_sets(pa.array(["a  B\tc d e"], pa.large_string()), 4)
    assert (flat[:2] == again).all()
