"""Operator 5: order-preserving sequence packing by dynamic programming.

The documents of an input split, in its order, are one stream of token ids, each
document ended by id 1.  The stream is cut into windows of at most ``window``
ids.  Cuts may stand at document ends (free), at sentence ends (``SENTENCE``) or,
where a sentence is very long and in the last window's reach of a run, inside a
sentence (``INSIDE``).  ``cost(j) = min over i of cost(i) + cut(i) + window -
(pos(j) - pos(i))`` is a sliding-window minimum of ``cost(i) + cut(i) + pos(i)``,
which a monotone queue holds, so a cut costs amortised constant time.  A window
whose length is a power of two needs no padding; that transition is used at the
end of a run, where the rest would otherwise be padded most.

A run ends after ``run_ids`` ids at the next document end, so memory is bounded by
that and the longest document.  No shuffle: splits are packed side by side, and a
recomputed split gives the same rows.  Null texts are empty documents (one id);
an empty table gives no rows; repeated rows are packed like any others.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_array
from .tokens import load_bpe

WINDOW, END_ID = 2048, 1
SENTENCE, INSIDE, GAP = 16.0, 48.0, 192
RUN_IDS = 1 << 20
#: Texts that are encoded at a time, and distinct pieces whose ids a worker remembers.
SLICE, KEEP = 500, 250_000


def _sentence_tables(lengths: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids that end a sentence, ids that begin with white space)."""
    ends, spaced = np.zeros(len(lengths), bool), np.zeros(len(lengths), bool)
    for b, i in ranks.items():
        ends[i] = b.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or b.endswith(b"\n")
        spaced[i] = b[:1] in b" \n\t\r"
    return ends, spaced


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, window: int, ends: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where the stream may be cut; 0 and the end are among them."""
    n = len(ids)
    sentence = np.flatnonzero(ends[ids[:-1]] & spaced[ids[1:]]) + 1 if n > 1 else np.zeros(0, np.int64)
    places = np.unique(np.concatenate([[0], sentence, doc_ends]))
    wide = np.flatnonzero(np.diff(places) > min(GAP, window))
    step = max(1, min(64, window // 4))
    extra = [np.arange(places[k] + step, places[k + 1], step) for k in wide]
    extra.append(np.arange(max(0, n - window), n))
    every = np.unique(np.concatenate([places, *extra]))
    pen = np.full(len(every), INSIDE)
    pen[np.searchsorted(every, sentence)] = SENTENCE
    pen[np.searchsorted(every, doc_ends)] = 0.0
    pen[0] = 0.0
    return every, pen


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices of the chosen cut places, first and last included."""
    pos, pen = places.tolist(), penalties.tolist()
    n, total = len(pos), int(places[-1])
    value = [0.0] * n  # cost(i) + cut(i) + pos(i)
    back = [0] * n
    value[0] = pen[0]
    queue: deque[int] = deque([0])
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    tail = total - window
    where = {0: 0}
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        cost = value[i] + window - p
        if p >= tail:
            for q in powers:
                k = where.get(p - q)
                if k is not None and value[k] - pos[k] < cost:
                    i, cost = k, value[k] - pos[k]
        back[j] = i
        v = value[j] = cost + pen[j] + p
        if p >= tail - window:
            where[p] = j
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def pack_run(ids: np.ndarray, doc_ends: np.ndarray, window: int, ends: np.ndarray, spaced: np.ndarray) -> np.ndarray:
    """Window boundaries of one run, 0 and the length included."""
    places, pen = cut_places(ids, doc_ends, window, ends, spaced)
    return places[best_cuts(places, pen, window)]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, run_ids: int = RUN_IDS) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32 bit), length, doc_tokens, sequence_id, offset.

    Sequences are numbered within each split; the split's number is in the high bits.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        bpe = load_bpe(tokenizer)
        ends, spaced = _sentence_tables(bpe.lengths, bpe.ranks)
        serial = TaskContext.get().partitionId() << 33

        def flush(parts, sizes, keys, serial):
            ids, size = np.concatenate(parts).astype("<u4", copy=False), np.concatenate(sizes)
            keys = pa.concat_arrays(keys)
            doc_ends = np.cumsum(size)
            cuts = pack_run(ids, doc_ends, window, ends, spaced)
            edges = np.union1d(cuts, np.concatenate([[0], doc_ends]))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, a, side="right")
            seq = np.searchsorted(cuts, a, side="right") - 1
            data = pa.py_buffer(ids.tobytes())
            for lo in range(0, len(a), 4096):
                s = slice(lo, lo + 4096)
                base = int(a[lo])
                off = pa.py_buffer(((np.append(a[s], b[s][-1]) - base) * 4).astype(np.int32).tobytes())
                body = pa.Array.from_buffers(pa.binary(), len(a[s]), [None, off, data.slice(base * 4)])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(doc[s])), pa.array(a[s] - (doc_ends - size)[doc[s]]), pa.array(b[s] - a[s]), body,
                        pa.array(size[doc[s]]), pa.array(serial + seq[s]), pa.array(a[s] - cuts[seq[s]]),
                    ],
                    names=names,
                )
            return serial + len(cuts) - 1

        parts, sizes, keys, held = [], [], [], 0
        for b in (x.slice(lo, SLICE) for x in batches for lo in range(0, x.num_rows, SLICE)):
            ids, off = bpe.encode_column(text_array(b), tail=END_ID, keep=KEEP)
            pa.default_memory_pool().release_unused()
            first = 0
            while first < b.num_rows:  # a run takes documents until it is full
                last = int(np.searchsorted(off, off[first] + max(1, run_ids - held)))
                last = min(max(last, first + 1), b.num_rows)
                parts.append(ids[off[first] : off[last]])
                sizes.append(np.diff(off[first : last + 1]))
                keys.append(b.column(0).slice(first, last - first))
                held += int(off[last] - off[first])
                first = last
                if held >= run_ids:
                    serial = yield from flush(parts, sizes, keys, serial)
                    parts, sizes, keys, held = [], [], [], 0
        if held:
            yield from flush(parts, sizes, keys, serial)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
