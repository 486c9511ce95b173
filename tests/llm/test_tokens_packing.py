"""Token counts, the BPE encoder and packing against the library and by round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

from tidemill.llm import packing, tokens  # noqa: E402

NAME = "byte_bpe_50k.json"
PIECES = [" ", "\n", "a", "Bc", "é", "12", ".", "'s", " ", "<|endoftext|>", "日本", "  ", "\t", " x", "\x1c", "!!"]


def library():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path(NAME))


def texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n \nb", "<|endoftext|>", "x<|endoftext|>  y", "日本 語", "we'll 'd", "\r\n a"]
    return fixed + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_columns_are_encoded_as_the_library_does():
    t, lib, bpe = texts(400), library(), tokens.load_bpe(NAME)
    for keep in (500_000, 0):
        ids, off = bpe.encode_column(pa.array(t, pa.large_string()), tail=1, keep=keep)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[*lib.encode(x, add_special_tokens=False).ids, 1] for x in t]


@pytest.mark.parametrize("chunk,overlap", [(8, 1), (8, 2), (40, 10), (1000, 10)])
def test_spliced_chunks_equal_the_whole(chunk, overlap):
    bpe, lib = tokens.load_bpe(NAME), library()
    for t in texts(300, chunk):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.concatenate([*bpe.spliced(t, chunk, overlap)]).tolist() == want
        assert bpe.count(t, chunk, overlap) == len(want)


def test_text_without_stable_places_widens_to_the_whole():
    t = "abc" * 500
    assert tokens.load_bpe(NAME).count(t, 64, 4) == len(library().encode(t, add_special_tokens=False).ids)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_counts_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", None), (3, "hello world", None), (None, "a b", "x"), (5, "word " * 30_000, "x")]
    got = sorted(map(tuple, tokens.count_tokens(documents(spark, rows)).collect()), key=repr)
    n = len(library().encode("word " * 30_000, add_special_tokens=False).ids)
    want = [(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False), (None, 3, 2, False), (5, 150_000, n, True)]
    assert got == sorted(want, key=repr)
    assert tokens.count_tokens(documents(spark, [])).collect() == []


@pytest.mark.parametrize("window,run_ids", [(16, 64), (64, 1 << 20), (2048, 1 << 20)])
def test_packing_round_trip(spark, window, run_ids):
    t = [*texts(60, 3), "A sentence here. Another one! " * 40, "x" * 3000]
    rows = [(i, x or None, "c") for i, x in enumerate(t)] + [(0, None, "again")]
    pieces = packing.pack(documents(spark, rows), window=window, run_ids=run_ids).collect()
    lib, want = library(), {}
    for i, x, _ in rows:
        want.setdefault(i, []).append([*lib.encode(x or "", add_special_tokens=False).ids, 1])
    seqs, got = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) >= 0
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        got.setdefault(p.doc_id, []).append((p.start, ids.tolist(), p.doc_tokens))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    for i, docs in want.items():
        flat = sorted(got[i])
        if len(docs) == 1:
            assert [x for _, ids, _ in flat for x in ids] == docs[0] and {n for *_, n in flat} == {len(docs[0])}
        else:
            assert sum(len(ids) for _, ids, _ in flat) == sum(map(len, docs))


def brute_cost(places, pen, window):
    """Plain quadratic recurrence over the same costs as the queue."""
    total, cost = places[-1], {0: 0.0}
    for j in range(1, len(places)):
        best = None
        for i in range(j):
            n = places[j] - places[i]
            if n > window or i not in cost:
                continue
            pad = 0 if n & (n - 1) == 0 and places[j] >= total - window and (places[i] >= total - 2 * window or i == 0) else window - n
            c = cost[i] + pad + pen[j] * (j < len(places) - 1)
            best = c if best is None else min(best, c)
        cost[j] = best
    return cost[len(places) - 1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    places = np.array([0, *sorted(rng.sample(range(1, 400), 120)), 400])
    gaps = np.flatnonzero(np.diff(places) > 32)
    places = np.unique(np.concatenate([places, *[np.arange(places[g], places[g + 1], 16) for g in gaps]]))
    pen = np.array([rng.choice([0.0, 16.0, 48.0]) for _ in places])
    pen[0] = 0.0
    cuts = packing.best_cuts(places, pen, 32)
    total, cost = int(places[-1]), 0.0
    for a, b in zip(cuts, cuts[1:]):
        n = int(places[b] - places[a])
        assert 0 < n <= 32
        cost += 0 if n & (n - 1) == 0 and places[b] >= total - 32 and (places[a] >= total - 64 or a == 0) else 32 - n
        cost += pen[b] if b != len(places) - 1 else 0
    assert cost == pytest.approx(brute_cost(places.tolist(), pen.tolist(), 32))
