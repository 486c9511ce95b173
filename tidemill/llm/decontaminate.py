"""Operator 6: benchmark decontamination with an FM-index per training shard.

A shard is a bounded piece of a partition's documents.  Words of the shard that
occur in no benchmark item can be part of no window, so they only separate; what
lies between them are *runs* of benchmark words, and a run shorter than the
shortest window cannot hold one.  The shard's index covers the remaining runs:

* a suffix array by prefix doubling that sorts on only what is still tied (runs
  are cut at ``SEGMENT`` words with an overlap of a window, which bounds the rounds);
* the Burrows-Wheeler transform as a wavelet matrix with popcount ranks;
* suffix positions sampled at every ``STEP``-th word of a run and at its start.

All distinct windows of the benchmark are searched backwards at once; the rows of
non-empty ranges walk by last-to-first steps to a sampled position.  The hits of a
document are merged into spans.  Words are compared by 64-bit hashes, and the bytes
of words in runs are compared with the benchmark word besides.

The benchmark is the stated query set.  Workers hold it as arrays, built once in each
and kept for its further tasks.  A benchmark above ``PART_BYTES`` is searched in
parts, dealt by hash of the item: each part is one pass over the documents that
adds its spans and items to theirs, and only one part at a time is on the driver or
a worker (an item is not split, so the longest one must fit).

Null or
empty texts have no words and are clean; long texts are a shard of their own and
searched whole; repeated rows and items are judged like
any others (an item that repeats another occurs wherever that occurs); items with
a null id are searched like others and together listed as one null, which counts as an
item and is no part of the digest, as in the SQL; an empty benchmark leaves all clean;
extra columns, whatever their names, are ignored or carried in ``row``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER, ROW, forget, hash_words, ragged, raw_bytes, saved, small_batches, text_array, text_or_row, with_row, word_hashes, word_spans

WINDOW, SEGMENT, STEP = 13, 4096, 8
#: A word-share of 1 / RATIO that is hit makes a document contaminated.
RATIO = 20
#: Benchmark text that is searched in one pass.
PART_BYTES = 8 << 20
SHARD_BYTES = 8 << 20


class FmIndex:
    """An FM-index over words 1 .. sigma-1; symbol 0 ends each segment."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, sigma: int, step: int = STEP):
        """symbols: all segments, each followed by its 0; ends: where those zeros are."""
        n = len(symbols)
        self.n, self.sigma, self.levels = n, sigma, max(1, int(sigma - 1).bit_length())
        order = _suffixes(symbols, ends, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        before = order - 1
        bwt = np.where(before >= 0, symbols[before], 0).astype(np.uint32)
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        # rows at segment starts are sampled, so that no walk crosses an end
        place = np.arange(n) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), np.diff(ends, prepend=-1))
        sampled = (place % step == 0) | starts
        self.marked = sampled[order]
        self.samples = order[self.marked]
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.bits, self.ranks, self.zeros = [], [], []
        seq = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            ones = bit.astype(bool)
            self.zeros.append(n - int(ones.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before row i of the transform."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at row i of the transform, its occurrences before)."""
        symbol, at, lo = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            one = (self.bits[k][word] >> rest) & np.uint64(1) == 1
            symbol = symbol << 1 | one
            a, b = self._ones(k, at), self._ones(k, lo)
            at, lo = np.where(one, self.zeros[k] + a, at - a), np.where(one, self.zeros[k] + b, lo - b)
        return symbol, at - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, given as rows that are right-aligned in a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for back in range(width):
            live = live[(lengths[live] > back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - back].astype(np.int64)
            base = self.first[c]
            lo[live], hi[live] = base + self.rank(c, lo[live]), base + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.samples[self.mark_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol, k = self.access(at)
                at = self.first[symbol] + k
                steps += 1
        return out


def _suffixes(symbols: np.ndarray, ends: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array; ends are smaller than all words and differ by place."""
    n = len(symbols)
    rank = np.empty(n, np.int64)
    rank[:] = symbols + len(ends)
    rank[ends] = np.arange(len(ends))
    width = 1
    order = np.argsort(rank, kind="stable")
    _rerank(rank, order, rank[order])
    tied = _ties(rank, order)
    while len(tied):
        # tied: positions in ``order`` whose rank is shared by a neighbour
        where = order[tied]
        key = rank[np.minimum(where + width, n - 1)]
        group = rank[where]
        re = np.lexsort([key, group])
        order[tied] = where[re]
        group, key, where = group[re], key[re], where[re]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[where] = tied[start]
        width *= 2
        single = new & np.concatenate([new[1:], [True]])
        tied = tied[~single]
    return order


def _rerank(rank: np.ndarray, order: np.ndarray, values: np.ndarray) -> None:
    new = np.concatenate([[True], values[1:] != values[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank[order] = start


def _ties(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    r = rank[order]
    same = np.concatenate([[False], r[1:] == r[:-1]])
    return np.flatnonzero(same | np.concatenate([same[1:], [False]]))


class Benchmark:
    """The query set: vocabulary, distinct windows and the items of each window."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        flat, off = raw_bytes(texts)
        flat = LOWER[flat]
        starts, ends, per = word_spans(flat, off, ALNUM_WORDS)
        words = [flat[a:b].tobytes() for a, b in zip(starts, ends)]
        vocabulary = sorted(set(words))
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], order.astype(np.int64) + 1
        self.sigma = len(vocabulary) + 1
        self.lengths = np.array([0] + [len(w) for w in vocabulary], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        coded = np.fromiter((code[w] for w in words), np.int32, len(words))
        # all windows as right-aligned rows of one matrix; items with none have no row
        n_win = np.where(per > 0, np.maximum(1, per - window + 1), 0)
        item = np.repeat(np.arange(len(items)), n_win)
        size = np.minimum(per, window)[item]
        first = (np.cumsum(per) - per)[item] + np.arange(len(item)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        rows = np.zeros((len(item), window), np.int32)
        at = np.arange(window) - (window - size)[:, None]
        inside = at >= 0
        rows[inside] = coded[(first[:, None] + at)[inside]]
        if len(rows):
            order = np.lexsort(rows.T[::-1])
            rows = rows[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
            self.patterns, self.sizes = rows[new], size[order][new].astype(np.int64)
            pair = np.unique((np.cumsum(new) - 1) * len(items) + item[order])
            self.item_of = pair % len(items)
            self.item_first = np.searchsorted(pair // len(items), np.arange(len(self.patterns) + 1))
        else:
            self.patterns, self.sizes, self.item_of, self.item_first = rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.names = [i for i, _ in items]
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0

    def items(self, window: int) -> set[int | None]:
        """Ids of the items that have a window."""
        return {self.names[i] for i in self.item_of[self.item_first[window] : self.item_first[window + 1]].tolist()}

    def encode(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The code of each word; 0 for words that are not in the vocabulary."""
        if self.sigma == 1 or not len(starts):
            return np.zeros(len(starts), np.int64)
        h = word_hashes(flat, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.codes[at], 0)

    def same_bytes(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        size = ends - starts
        ok = self.lengths[codes] == size
        a, b, c = starts[ok], self.offsets[codes[ok]], size[ok]
        differ = flat[ragged(a, c)] != self.bytes[ragged(b, c)]
        bad = np.concatenate([[0], np.cumsum(differ)])
        last = np.cumsum(c)
        ok[ok] = bad[last] == bad[last - c]
        return ok


def search_shard(texts: pa.Array, bench: Benchmark, segment: int = SEGMENT) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """(words per document, merged spans of hit words [first, past last), items) of a shard."""
    flat, off = raw_bytes(texts)
    flat = LOWER[flat]
    starts, ends, per = word_spans(flat, off, ALNUM_WORDS)
    n_docs = len(per)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[set[int]] = [set() for _ in range(n_docs)]
    if not len(bench.sizes) or not len(starts):
        return per, spans, items
    codes = bench.encode(flat, starts, ends)
    doc_first = np.concatenate([[0], np.cumsum(per)])
    # maximal runs of benchmark words within documents
    known = codes > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    heads = doc_first[:-1][per > 0]
    begin[heads] = known[heads]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    tails = doc_first[1:][per > 0] - 1
    stop[tails] = known[tails]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= bench.shortest
    a, b = a[long], b[long]
    if not len(a):
        return per, spans, items
    inside = ragged(a, b - a)
    wrong = ~bench.same_bytes(flat, starts[inside], ends[inside], codes[inside])
    if wrong.any():  # a hash collision: the word is another one
        codes[inside[wrong]] = 0
        return _with_codes(codes, per, doc_first, bench, segment, spans, items)
    return _indexed(codes, a, b, per, doc_first, bench, segment, spans, items)


def _with_codes(codes, per, doc_first, bench, segment, spans, items):
    known = codes > 0
    doc = np.repeat(np.arange(len(per)), per)
    edge = np.concatenate([[True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])])
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(codes))
    ok = known[a] & (b - a >= bench.shortest)
    return _indexed(codes, a[ok], b[ok], per, doc_first, bench, segment, spans, items) if ok.any() else (per, spans, items)


def _indexed(codes, a, b, per, doc_first, bench, segment, spans, items):
    # long runs become overlapping segments, so that sorting needs few rounds
    size = b - a
    pieces = np.maximum(1, -(-(size - bench.window) // segment))
    which = np.repeat(np.arange(len(a)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sa = a[which] + k * segment
    sb = np.minimum(b[which], sa + segment + bench.window)
    length = sb - sa
    n = int(length.sum()) + len(sa)
    zero = np.cumsum(length + 1) - 1
    symbols = np.zeros(n, np.int64)
    mask = np.ones(n, bool)
    mask[zero] = False
    word_of = np.zeros(n, np.int64)
    word_of[mask] = ragged(sa, length)
    symbols[mask] = codes[word_of[mask]]
    index = FmIndex(symbols, zero, bench.sigma)
    lo, hi = index.search(bench.patterns, bench.sizes)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return per, spans, items
    for part in np.array_split(hit, max(1, int((hi - lo)[hit].sum()) >> 20)):  # bounded: a million occurrences at a time
        count = (hi - lo)[part]
        at = word_of[index.locate(ragged(lo[part], count))]
        pattern = np.repeat(part, count)
        doc = np.searchsorted(doc_first, at, side="right") - 1
        _merge(at - doc_first[doc], doc, bench.sizes[pattern], spans)
        seen = np.unique(doc * len(bench.sizes) + pattern)
        for d, p in zip((seen // len(bench.sizes)).tolist(), (seen % len(bench.sizes)).tolist()):
            items[d].update(bench.items(p))
    return per, spans, items


def _merge(at: np.ndarray, doc: np.ndarray, size: np.ndarray, spans: list[list[tuple[int, int]]]) -> None:
    order = np.argsort(doc, kind="stable")
    doc, at, size = doc[order], at[order], size[order]
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        d = int(doc[i])
        spans[d] = union(spans[d] + list(zip(at[i:j].tolist(), (at[i:j] + size[i:j]).tolist())))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shards(batches, limit: int = SHARD_BYTES):
    """Slices of record batches with at most ``limit`` text bytes (or one row)."""
    for b in batches:
        texts = text_array(b)
        _, off = raw_bytes(texts)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield b.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            lo = hi


_BUILT: dict[str, Benchmark] = {}


def _built(name: str, query_set: list, window: int) -> Benchmark:
    """The worker's arrays of a part; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(query_set, window)
    return _BUILT[name]


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans of hit words, items, contaminated; a narrow map without a shuffle.

    With ``carry`` also the document's own columns in the struct ``row``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    names = ["doc_id", "n_words", "n_hit", "spans", "items", "contaminated"]
    schema = "doc_id long, n_words long, n_hit long, spans array<struct<first:long,past:long>>, items array<long>, contaminated boolean"
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def pass_over(rows: DataFrame, part: int, last: bool) -> DataFrame:
        """Search one part; rows of a later pass have the spans and items so far."""
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        query_set = [(r[0], r[1]) for r in mine.collect()]
        handle, name, kept = spark.sparkContext.broadcast(query_set), uuid.uuid4().hex, carry or not last

        def run(batches):
            bench = _built(name, handle.value, window)
            for b, texts in shards(batches):
                per, spans, found = search_shard(texts, bench)
                if part:
                    spans = [union(s + [(x["first"], x["past"]) for x in old]) for s, old in zip(spans, b.column(2).to_pylist())]
                    found = [f | set(old) for f, old in zip(found, b.column(3).to_pylist())]
                n_hit = [sum(y - x for x, y in s) for s in spans]
                columns = [
                    b.column(0), pa.array(per), pa.array(n_hit, pa.int64()), pa.array([[{"first": x, "past": y} for x, y in s] for s in spans], span),
                    pa.array([sorted(f, key=str) for f in found], pa.list_(pa.int64())), pa.array([h > 0 and RATIO * h >= n for h, n in zip(n_hit, per.tolist())], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, b.column(1)] if kept else columns, names=[*names, ROW] if kept else names)

        return rows.mapInArrow(run, with_row(docs, schema, kept))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_row(docs, carry or parts > 1))
    done = None
    for part in range(parts):
        before, done = done, pass_over(rows, part, part == parts - 1)
        if part < parts - 1:
            done = saved(done)
            rows = done.select("doc_id", ROW, "spans", "items")
        forget(before if part < parts - 1 else None)
    return done


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    listed = F.concat_ws(",", F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")

