"""Operator 10: quality classification by a generalised additive model with pairwise interactions.

Each feature of the whole text is cut into bins at quantiles of the sample.
Cyclic boosting visits the features in turn; a visit fits a shallow tree (at most
four leaves) to the gradient sums of the feature's bins and adds it, shrunk, to
that feature's lookup table.  Afterwards the pairs of features whose bins still
explain most of the gradient get two-dimensional tables of four-leaf trees.  A
score is the sigmoid of the sum of table cells.

Learning reads a bounded sample of labelled documents that are not held out
(``per_class`` of each label; only numbers reach the driver), weighted back to
the labels' shares.  A document counts once for a label, however often it is
labelled; if documents repeat an id, the row with the smallest features is learned
from.  Null and empty texts have all features 0 and are scored; very long texts are
measured whole, in time linear but for sorting their words; equal scores and repeated
rows need no rule; without any label every score is 0.5.  Extra columns, whatever
their names, are ignored or carried in ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE_WORDS, bounded_sample, fold, held_out, raw_bytes, small_batches, text_array, text_or_row, with_row, word_hashes, word_spans

FEATURES = ["log_words", "word_len", "long_words", "symbols", "pipes", "upper", "digits", "punct", "bangs", "repeat_words", "top_word", "dup_line_bytes", "line_words", "short_lines", "dup_triples", "newlines"]
PER_CLASS, THRESHOLD = 10_000, 0.7
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:?\"'()-", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_LINE = np.ones(256, bool)
_LINE[10] = False


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    flat, off = raw_bytes(texts)
    n, size = len(off) - 1, np.maximum(1, np.diff(off))
    starts, ends, per = word_spans(flat, off, SPACE_WORDS)
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((n, len(FEATURES)))
    words = np.maximum(1, per)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[flat])])
        return (sums[off[1:]] - sums[off[:-1]]) / size

    wlen = np.concatenate([[0], np.cumsum(ends - starts)])
    longs = np.concatenate([[0], np.cumsum(ends - starts > 12)])
    out[:, 0] = np.log1p(per)
    out[:, 1] = (wlen[first[1:]] - wlen[first[:-1]]) / words
    out[:, 2] = (longs[first[1:]] - longs[first[:-1]]) / words
    out[:, 3] = share(_SYMBOL)
    out[:, 4] = share(np.arange(256) == 0x7C)
    out[:, 5] = share(_UPPER)
    out[:, 6] = share(_DIGIT)
    out[:, 7] = share(_PUNCT)
    out[:, 8] = share(np.arange(256) == 0x21)
    out[:, 15] = share(np.arange(256) == 0x0A)
    h = word_hashes(flat, starts, ends)
    ls, le, lper = word_spans(flat, off, _LINE)
    lh = word_hashes(flat, ls, le)
    lfirst = np.concatenate([[0], np.cumsum(lper)])
    at_word = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    lwords = at_word[1] - at_word[0]
    for i in range(n):
        w = h[first[i] : first[i + 1]]
        if not len(w):
            continue
        s = np.sort(w)
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        out[i, 9] = 1 - (len(edge) - 1) / len(w)
        out[i, 10] = np.diff(edge).max() / len(w)
        if len(w) > 3:
            t = np.sort(w[:-2] * np.uint64(3) ^ w[1:-1] * np.uint64(5) ^ w[2:] * np.uint64(7))
            out[i, 14] = (t[1:] == t[:-1]).mean()
        k = slice(lfirst[i], lfirst[i + 1])
        line, lens = lh[k], (le - ls)[k]
        if len(line):
            _, idx = np.unique(line, return_index=True)
            out[i, 11] = 1 - lens[idx].sum() / lens.sum()
            out[i, 12] = np.log1p(len(w) / len(line))
            out[i, 13] = (lwords[k] <= 2).mean()
    return out


class AdditiveModel:
    """Lookup tables for features and pairs; ``score`` adds cells and takes the sigmoid."""

    def __init__(self, cuts, base, tables, coarse, pairs):
        self.cuts, self.base, self.tables, self.coarse, self.pairs = cuts, base, tables, coarse, pairs

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            total += t[b]
        for (j, k), t in self.pairs.items():
            total += t[self.coarse[j][bins[j]], self.coarse[k][bins[k]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    @classmethod
    def fit(cls, x, y, weight, bins: int = 48, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 40, grid: int = 8):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        p0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        model = cls(cuts, float(np.log(p0 / (1 - p0))), [np.zeros(len(c) + 1) for c in cuts], [], {})
        b = model.bins(x)
        total = np.full(len(x), model.base)

        def gradient():
            p = 1 / (1 + np.exp(-total))
            return weight * (y - p), weight * p * (1 - p)

        for _ in range(rounds):
            for j, t in enumerate(model.tables):
                g, h = gradient()
                step = rate * _tree(np.bincount(b[j], g, len(t)), np.bincount(b[j], h, len(t)))
                t += step
                total += step[b[j]]
        model.coarse = [np.minimum(np.arange(len(t)) * grid // max(1, len(t)), grid - 1) for t in model.tables]
        c = [m[k] for m, k in zip(model.coarse, b)]

        def sums(j, k):
            g, h = gradient()
            cell = c[j] * grid + c[k]
            return np.bincount(cell, g, grid * grid).reshape(grid, grid), np.bincount(cell, h, grid * grid).reshape(grid, grid)

        gains = {(j, k): _quad(*sums(j, k))[1] for j, k in combinations(range(len(b)), 2)}
        chosen = sorted(gains, key=lambda q: (-gains[q], q))[:n_pairs]
        model.pairs = {q: np.zeros((grid, grid)) for q in chosen}
        for _ in range(pair_rounds):
            for (j, k), t in model.pairs.items():
                step = rate * _quad(*sums(j, k))[0]
                t += step
                total += step[c[j], c[k]]
        return model


def _split(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 5.0) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut; 0 if none has enough weight on both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge), 0.0)
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a best-first tree over one feature's bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_split(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if not at or gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quad(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """(table, gain) of the best tree that cuts each of two features once."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    inner = slice(1, -1)
    rows = cg[inner, inner], ch[inner, inner]
    box = lambda c, top: (top, c[inner, -1:] - top, c[-1:, inner] - top, c[-1, -1] - c[inner, -1:] - c[-1:, inner] + top)
    gs, hs = box(cg, rows[0]), box(ch, rows[1])
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [gs[q][i, j] / (hs[q][i, j] + ridge) for q in range(4)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 4) -> AdditiveModel | None:
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(fold(mod) != 2)
    few, counts = bounded_sample(marked, "quality", per_class)
    if len(counts) < 2:
        return None

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                x = features(text_array(s))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text")
    # one row for each sampled id and label, so at most two for an id
    got = sampled.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    y = np.array(got["quality"].to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(len(y), -1)
    order = np.lexsort([*x.T, y])  # the same model whatever order rows come in
    x, y = x[order], y[order]
    weight = np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    return AdditiveModel.fit(x, y, weight * len(y) / weight.sum())


def score(docs: DataFrame, model: AdditiveModel | None, threshold: float = THRESHOLD, mod: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``carry`` also the document's own columns in the struct ``row``."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_row(docs, carry), held_out(mod).alias("held_out"))
    names = ["doc_id", "held_out", "score", "predicted", *([ROW] if carry else [])]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                p = np.full(s.num_rows, 0.5) if model is None else model.score(features(text_array(s)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *([s.column(1)] if carry else [])], names=names)

    return base.mapInArrow(run, with_row(docs, "doc_id long, held_out boolean, score double, predicted int", carry))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score(docs, learn(docs, labels, per_class))
