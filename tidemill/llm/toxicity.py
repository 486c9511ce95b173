"""Operator 3: toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded: lower case, accents off, look-alike letters and digits that stand
for letters become plain letters, characters without width go, all else becomes a
space.  The lexicon holds whole words (" word ") and word beginnings (" stem"), so the
automaton needs no boundary test besides; *dense* stems, which clean texts have too,
count where they begin two words and 1 / DENSE of all words or more.  A match inside an
exception phrase does not count, nor does a lighter match that begins where another
does.  The weights of all
matches are summed and also divided by the text's length; a logistic curve of both
gives the score.

Learning reads a bounded sample of labelled documents that are not held out
(``per_class`` of each label), each whole, and only on the workers: what comes to the
driver is two numbers a document, terms and phrases that pass their tests, and four
measures a document.  Near copies within the sample are left out.  Terms are chosen on
one half by their smoothed log odds; exceptions are neighbours that a term has in
clean texts only; the curve is fitted on the other half.

A document counts once for a label, however often it is labelled; if documents repeat
an id, one row with the smallest keys is learned from.  Null and empty texts have no
match and get the score of such texts; texts of any length are read whole in time
linear in their characters and matches; equal scores and repeated rows need no rule;
without labels all scores are 0.  Extra columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold as id_fold, forget, held_out, saved, small_batches, text_array

PER_CLASS, THRESHOLD = 4_000, 0.3
#: A term needs LEAST toxic documents, ODDS in log odds, and a chance below CHANCE of being that toxic by accident.
LEAST, ODDS, CHANCE = 5, 2.0, 1e-7
DENSE = 100
#: Characters that stand for a Latin letter.
LOOK_ALIKE = {
    "a": "а@4ａαɑ", "b": "Ьｂ", "c": "сｃϲ", "d": "ԁｄ", "e": "е3ｅε", "f": "ｆ", "g": "ɡｇ9", "h": "һｈ", "i": "і1!ｉıι",
    "j": "јｊ", "k": "кｋκ", "l": "ӏｌ", "m": "ｍм", "n": "ｎ", "o": "о0ｏοσ", "p": "рｐρ", "q": "ԛｑ", "r": "гｒ",
    "s": "ѕ5$ｓ", "t": "т7ｔτ", "u": "ｕυ", "v": "ѵｖν", "w": "ԝｗ", "x": "хｘχ", "y": "уｙγ", "z": "ｚ2",
}
_SOFT = "!$@"  # letters only within a word


LOOKS = {ord(c): plain for plain, others in LOOK_ALIKE.items() for c in others}


class _Fold(dict):
    """A translation table filled as characters are met."""

    def __missing__(self, code: int) -> str:
        low = chr(code).lower()
        if len(low) == 1 and ord(low) in LOOKS:
            low = LOOKS[ord(low)]
        else:
            base = unicodedata.normalize("NFKD", low)
            low = base[0] if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) else low
            low = LOOKS.get(ord(low), low) if len(low) == 1 else low
        self[code] = out = low if low.isalpha() else "" if unicodedata.category(chr(code)) in ("Mn", "Cf") else " "
        return out


_TABLE = _Fold(LOOKS)
#: Runs of digits and marks at a word's end, or at its beginning unless letters follow, stand for themselves.
_EDGE = re.compile(r"(?<![!$@0-9])[!$@0-9]++(?=[^\w!$@]|$)|(?<![\w!$@])[0-9!$@]+(?=[^\w]|$)")
#: Characters without width that may stand within a word.
_NO_WIDTH = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")


def folded(text: str) -> str:
    """The folded text between two spaces; words are apart by one space or more."""
    if not text.isascii():
        text = _NO_WIDTH.sub("", text)
    return f" {_EDGE.sub(' ', text).translate(_TABLE)} "


def _prefixes(words: set[str], shortest: int = 4, longest: int = 9) -> set[str]:
    return {w[:k] for w in words for k in range(shortest, min(longest, len(w) - 1) + 1)}


def _dense(words: list[str]) -> list[str]:
    """Beginnings of two words or more that make up 1 / DENSE of all words."""
    if not words:
        return []
    counts: Counter[str] = Counter()
    for w, c in Counter(words).items():
        for k in range(4, min(9, len(w)) + 1):
            counts[w[:k]] += c
    return [p for p, c in counts.items() if c >= 2 and c * DENSE >= len(words)]


def _keys(text: str, order: list[str]) -> tuple[int, int]:
    """Two numbers of a text; near copies share one (of the hashed word triples, the least and the greatest)."""
    if len(order) <= 8:
        k = zlib.crc32(text.encode())
        return k, k
    triples = [zlib.crc32(" ".join(order[i : i + 3]).encode()) for i in range(len(order) - 2)]
    return min(triples), max(triples)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: np.ndarray, dense: dict[str, float] | None = None):
        self.weights, self.exceptions, self.curve, self.dense = weights, exceptions, curve, dense or {}
        self._auto = None

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    @property
    def automaton(self):
        if self._auto is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), "safe", 0.0))
            for stem, w in self.dense.items():
                a.add_word(stem, (len(stem), stem, w))
            for term, w in self.weights.items():
                a.add_word(term, (len(term), "", w))
            if len(a):
                a.make_automaton()
            self._auto = a
        return self._auto

    def measure(self, text: str) -> tuple[float, int, float]:
        """(sum of weights, matches, words) of a text."""
        f = folded(text)
        size = len(f) / 6
        if not len(self.automaton):
            return 0.0, 0, size
        hits, safe, stems = [], [], Counter()
        for end, (n, kind, w) in self.automaton.iter(f):
            if kind == "safe":
                safe.append((end - n + 1, end + 1))
            elif kind:
                stems[kind] += 1
            else:
                hits.append((end - n + 1, end + 1, w))
        if safe and hits:  # both by their beginnings: the furthest end so far covers a hit or nothing does
            hits.sort()
            safe.sort()
            left, reach, k = [], 0, 0
            for h in hits:
                while k < len(safe) and safe[k][0] <= h[0]:
                    reach = max(reach, safe[k][1])
                    k += 1
                if h[1] > reach:
                    left.append(h)
            hits = left
        best: dict[int, float] = {}
        for a, _, w in hits:  # a word counts once, by its heaviest term
            best[a] = max(w, best.get(a, 0.0))
        total, found = sum(best.values()), len(best)
        if stems and max(stems.values()) > 1:
            words = len(f.split())
            for stem, c in stems.items():
                if c >= 2 and c * DENSE >= words:
                    total, found = total + self.dense[stem], found + 1
        return total, found, size

    def design(self, texts: list[str]) -> np.ndarray:
        return self.columns(np.array([self.measure(t) for t in texts], float).reshape(-1, 3))

    @staticmethod
    def columns(m: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(m)), np.log1p(m[:, 0]), np.minimum(m[:, 1], 3), np.minimum(m[:, 0] / np.sqrt(m[:, 2] + 1), 5)])

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(texts) @ self.curve, -30, 30))) if texts else np.zeros(0)


def choose_terms(found: list[tuple[str, int, int]], n: tuple[int, int], least: int = LEAST, odds: float = ODDS, chance: float = CHANCE) -> dict[str, float]:
    """Weights of the terms that pass; ``found``: (term, toxic documents, clean documents), ``n``: (clean, toxic) documents."""
    weights: dict[str, float] = {}
    for term, tox, clean in sorted(found, key=lambda f: (len(f[0]), f[0])):
        if tox < least or any(term[:k] in weights for k in range(5, len(term))):
            continue
        ratio = math.log((tox + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
        if ratio >= odds and _log_tail(tox, tox + clean, n[1] / (n[0] + n[1])) < math.log(chance) and (term[-1] == " " or clean <= max(1, 0.02 * tox)):
            weights[term] = round(ratio, 6)
    return weights


def choose_dense(found: list[tuple[str, int, int]], n: tuple[int, int], least: int = LEAST, odds: float = ODDS, chance: float = CHANCE) -> dict[str, float]:
    """Weights of the dense stems that pass, the strongest of those that begin alike."""
    odd = lambda tox, clean: math.log((tox + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
    out: dict[str, float] = {}
    for stem, tox, clean in sorted(found, key=lambda f: (-odd(f[1], f[2]) * math.sqrt(f[1]), f[0])):
        if tox < least or odd(tox, clean) < odds or any(stem.startswith(o) or o.startswith(stem) for o in out):
            continue
        if _log_tail(tox, tox + clean, n[1] / (n[0] + n[1])) < math.log(chance) and clean <= 0.25 * tox:
            out[stem] = round(odd(tox, clean), 6)
    return out


def _log_tail(k: int, n: int, p: float) -> float:
    """Natural logarithm of P(X >= k) for X ~ Bin(n, p), k > n p."""
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, ratio = 1.0, 1.0
    for i in range(k, n):
        ratio *= (n - i) / (i + 1) * p / (1 - p)
        total += ratio
        if ratio < 1e-12:
            break
    return term + math.log(total)


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps; rows are weighted so that label 1 has the given share."""
    w = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    keep = np.array([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - keep * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return b


def _per_text(rows: DataFrame, schema: str, of_text) -> DataFrame:
    """``of_text(id, label, text)`` gives a row or None."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for x in map(of_text, b.column(0).to_pylist(), b.column(1).to_pylist(), text_array(b).to_pylist()) if x is not None]
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t.split()[1]]) for c, t in zip(columns, schema.split(", "))], names=names)

    return rows.mapInArrow(run, schema)


def _counted(rows: DataFrame, of_text, most: int = 200_000) -> DataFrame:
    """term, tox, clean: documents by label that have each of the terms of ``of_text(id, label, text)``."""

    def flush(counts):
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0)]], names=["term", "tox", "clean"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for b in batches:
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_array(b).to_pylist()):
                counts[y].update(of_text(i, y, t) or ())
                if len(counts[0]) + len(counts[1]) > most:
                    yield flush(counts)
                    counts = Counter(), Counter()
        yield flush(counts)

    return rows.mapInArrow(run, "term string, tox long, clean long").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))


def _halves(keys: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(id, label, keys, half) of the documents that are no near copies of earlier ones."""
    seen: set[int] = set()
    out = []
    for i, y, a, b in sorted(keys):
        if a not in seen and b not in seen:
            out.append((i, y, a, b, len(out) % 2))
        seen |= {a, b}
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 4) -> Lexicon | None:
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(id_fold(mod) != 2)
    few, counts = bounded_sample(marked, "toxic", per_class)
    if len(counts) < 2:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = saved(texts.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text").distinct())
    keyed = _per_text(sample, "doc_id long, toxic int, a long, b long", lambda i, y, t: (i, y, *_keys(t, folded(t).split())))
    # at most one row for each sampled id and label
    rows = keyed.groupBy("doc_id", "toxic").agg(F.min(F.struct("a", "b")).alias("k")).select("doc_id", "toxic", "k.a", "k.b").collect()
    used = _halves([tuple(r) for r in rows])
    n = tuple(sum(1 for u in used if u[1] == y and u[4] == 0) for y in (0, 1))
    if not n[0] or not n[1]:
        forget(sample)
        return None

    def of_half(which: int, of_text):
        """``of_text`` where the document is of the half; keys tell it from other rows of its id."""
        mine = {u[:4] for u in used if u[4] == which}

        def run(i, y, t):
            words = folded(t).split()
            return of_text(y, t, words) if (i, y, *_keys(t, words)) in mine else None

        return run

    def terms_of(y, t, words):
        distinct = set(words)
        return [f" {w} " for w in distinct] + [f" {p}" for p in _prefixes(distinct)] + [f"2 {p}" for p in _dense(words)]

    likely = f"tox >= {LEAST} and (tox + 0.5) / {n[1] + 1} >= {math.exp(ODDS) * 0.999} * (clean + 0.5) / {n[0] + 1}"
    found = _counted(sample, of_half(0, terms_of)).filter(likely).collect()
    found = [(r[0], int(r[1]), int(r[2])) for r in found]
    weights = choose_terms([f for f in found if f[0][0] == " "], n)
    dense = choose_dense([(t[1:], tox, clean) for t, tox, clean in found if t[0] == "2" and not any(t[1:k] in weights for k in range(5, len(t) + 1))], n)

    def phrases_of(y, t, words):
        return [f" {a} {b} " for a, b in zip(words, words[1:]) for w in (a, b) if any(f" {w} "[:k] in weights for k in range(5, len(w) + 3))]

    near = _counted(sample, of_half(0, phrases_of)).filter("clean >= 3 and tox = 0").select("term").collect() if weights else []
    lexicon = Lexicon(weights, sorted(r[0] for r in near), np.zeros(4), dense)
    measured = _per_text(sample, "toxic int, weight double, matches double, words double", of_half(1, lambda y, t, words: (y, *map(float, lexicon.measure(t)))))
    rows = sorted(tuple(r) for r in measured.collect())
    forget(sample)
    if rows:
        m = np.array(rows, float)
        lexicon.curve = _logistic(Lexicon.columns(m[:, 1:]), m[:, 0], counts[1] / (counts[0] + counts[1]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon | None, threshold: float = THRESHOLD, mod: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted; a narrow map without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = np.zeros(b.num_rows) if lexicon is None else lexicon.score(text_array(b).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(mod).alias("held_out"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score(docs, learn(docs, labels, per_class))
