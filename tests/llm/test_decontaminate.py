"""The FM-index and the decontamination operator against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, w):
    out = []
    for t in docs:
        words = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for i, x in items:
            x = WORD.findall((x or "").translate(LOW))
            for k in range(max(1, len(x) - w + 1) if x else 0):
                win = x[k : k + w]
                for p in range(len(words) - len(win) + 1):
                    if words[p : p + len(win)] == win:
                        found.add(i)
                        hit.update(range(p, p + len(win)))
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_shards_equal_brute_force(seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "x1", "日本", "zz", "q"][: rng.randint(1, 7)]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 5, 13, 14, 20]))) for i in range(rng.randint(1, 6))]
    docs = [make(rng.randint(0, 9)) + rng.choice(items)[1] + " unk " + make(rng.randint(0, 40)) for _ in range(8)]
    docs += [*docs[:2], "", None]
    w = rng.choice([13, 3, 4])
    per, spans, found = d.search_shard(pa.array([t or "" for t in docs], pa.large_string()), d.Benchmark(items, w), segment=rng.choice([5, 20, 4096]))
    assert [(int(p), sum(b - a for a, b in s), sorted(f)) for p, s, f in zip(per, spans, found)] == brute(docs, items, w)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 300)
    ends = np.array([99, 200, 299])
    text[ends] = 0
    index = d.FmIndex(text, ends, 4, step=5)
    for n in (1, 2, 5):
        for _ in range(20):
            pattern = rng.integers(1, 4, n)
            lo, hi = index.search(pattern[None, :], np.array([n]))
            want = [i for i in range(300 - n + 1) if (text[i : i + n] == pattern).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_operator_on_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    rows = [(1, passage, "x"), (2, None, "x"), (3, "", "x"), (4, "clean words only", None), (1, passage, "x"), (None, passage + " tail " * 600, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string")
    bench = spark.createDataFrame([(7, passage), (8, passage), (9, None)], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in d.digest(d.find(docs, bench)).collect()), key=repr)
    assert got == sorted([(1, 14, 14, 2, True), (1, 14, 14, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 3, 0, 0, False), (None, 614, 14, 2, False)], key=repr)
    assert not any(r.contaminated for r in d.find(docs, bench.limit(0)).collect())
    assert d.find(docs.limit(0), bench).collect() == []
    kept = d.find(docs, bench, carry=True).select("row.*")
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() == len(rows)
    again = d.find(docs, bench, part_bytes=1)
    assert again.exceptAll(d.find(docs, bench)).count() == 0 and again.columns == d.find(docs, bench).columns


def test_items_with_null_ids_are_searched(spark):
    passage, other = (" ".join(f"{c}{i}" for i in range(14)) for c in "wv")
    docs = spark.createDataFrame([(1, passage), (2, passage + " " + other), (3, "clean words")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, passage), (7, other), (None, passage)], "item_id bigint, text string")
    found = d.find(docs, bench)
    got = sorted((r.doc_id, r.n_hit, r.items, r.contaminated) for r in found.collect())
    assert got[0] == (1, 14, [None], True) and got[2] == (3, 0, [], False)
    assert got[1][:2] == (2, 28) and set(got[1][2]) == {None, 7} and got[1][3]
    digests = {r.doc_id: (r.n_items, r.items_sha256) for r in d.digest(found).collect()}
    assert digests == {i: (n, hashlib.sha256(t).hexdigest()) for i, n, t in ((1, 1, b""), (2, 2, b"7"), (3, 0, b""))}
