"""Operator 7: language identification by hierarchical discrimination.

Letters of the whole text become hashed byte trigrams (square-rooted relative
counts, unit length).  Linear support vector machines, one for each pair of
families, vote for the family; within it, one for each pair of languages votes for
the language.  A family is a fixed value of :data:`FAMILIES`; a code that it does
not know is a family of its own.

Learning reads a bounded sample of documents that have a language and are not held
out: of the ``LANGUAGES`` most frequent languages, ``per_language`` documents each,
smallest hash of doc_id first, and ``SAMPLE`` together at most.  One scan of the ids
counts the languages, one picks the sample and one reads its texts, however many
languages there are; null texts in the sample are left out.  Texts without a letter,
and nulls, are ``und`` with score 1; if no language could be learned, every row is
``und`` with score 0.  Texts of any length are read whole in linear time.  Ties of
votes go to the larger margins, then to the first name.  Extra columns, whatever their
names, are ignored or carried in ``row``; repeated rows are scored like any others; an
empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, ROW, bounded_sample, fold, held_out, raw_bytes, small_batches, text_array, text_or_row, with_row

#: Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIM, PER_LANGUAGE, LANGUAGES, SAMPLE = 2048, 1000, 64, 16_000


def features(texts: pa.Array, dim: int = DIM) -> np.ndarray:
    """Unit rows of square-rooted hashed trigram counts over the letters' bytes."""
    flat, off = raw_bytes(texts)
    n = len(off) - 1
    keep = np.zeros(256, bool)
    keep[0x61:0x7B] = True
    keep[0x80:] = True
    b = LOWER[flat].astype(np.uint32)
    b[~keep[b]] = 32
    out = np.zeros((n, dim), np.float32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - dim.bit_length() + 1)
        blank = (b[:-2] == 32) & (b[1:-1] == 32)
        for i in range(n):
            lo, hi = off[i], off[i + 1] - 2
            if hi > lo:
                out[i] = np.bincount(h[lo:hi][~blank[lo:hi]], minlength=dim)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear machine; y is +1 / -1.  Accelerated full gradients."""
    x, y = np.hstack([x, np.ones((len(x), 1), np.float32)]), y.astype(np.float32)
    scale = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 + 4.0 * c)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = v - np.float32(2 * c) * (x.T @ (scale * y * slack))
        new = v - np.float32(step) * g
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class LanguageModel:
    def __init__(self, families: list[str], by_family: dict[str, list[str]], top: dict, within: dict):
        self.families, self.by_family, self.top, self.within = families, by_family, top, within

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        lang = np.array(langs, object)
        family = np.array([FAMILY_OF.get(a, a) for a in langs], object)
        families = sorted(set(family))
        pair = lambda key, a, b: fit_svm(x[(m := (key == a) | (key == b))], np.where(key[m] == a, 1.0, -1.0))
        by_family = {f: sorted(set(lang[family == f])) for f in families}
        return cls(families, by_family, {(a, b): pair(family, a, b) for a, b in combinations(families, 2)}, {(a, b): pair(lang, a, b) for ls in by_family.values() for a, b in combinations(ls, 2)})

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its weakest duel as a probability); votes first, then margins."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        votes, sums, weakest = (np.zeros((len(x), len(names))) for _ in range(3))
        weakest[:] = np.inf
        for i, j in combinations(range(len(names)), 2):
            w = machines[names[i], names[j]]
            m = x @ w[:-1] + w[-1]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += s > 0
                sums[:, k] += np.tanh(s)
                weakest[:, k] = np.minimum(weakest[:, k], s)
        best = np.argmax(votes + sums / (4 * len(names)), 1)
        return best, 1 / (1 + np.exp(-3 * np.clip(weakest[np.arange(len(x)), best], -20, 20)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, score = np.empty(len(x), object), np.zeros(len(x))
        fam, p = self._vote(x, self.families, self.top)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(fam == k)
            if len(rows):
                which, q = self._vote(x[rows], self.by_family[f], self.within)
                out[rows] = np.array(self.by_family[f], object)[which]
                score[rows] = p[rows] * q
        return out, score


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, mod: int = 4) -> LanguageModel | None:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(mod) != 2))
    # the ids are picked without reading a text
    ids, counts = bounded_sample(rows.select("doc_id", "lang"), "lang", per_language, LANGUAGES)
    if not counts:
        return None
    ids = ids.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("_k") <= max(1, SAMPLE // len(counts))).select("doc_id", "lang")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                x = features(text_array(s)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    sampled = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").filter("text is not null").select("doc_id", "lang", "text")
    # one row for each sampled id and language, whatever repeats it, in an order of its own
    got = sampled.mapInArrow(run, "doc_id long, lang string, x binary").groupBy("doc_id", "lang").agg(F.min("x").alias("x")).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    return LanguageModel.fit(x, got["lang"].to_pylist())


def predict(docs: DataFrame, model: LanguageModel | None, mod: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with ``carry`` also the document's own columns in the struct ``row``."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_row(docs, carry), held_out(mod).alias("held_out"))
    names = ["doc_id", "held_out", "lang_pred", "score", *([ROW] if carry else [])]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                texts = text_array(s)
                letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
                lang, score = np.full(len(texts), "und", object), np.where(letter, 0.0, 1.0)
                if model is not None and letter.any():
                    a, p = model.predict(features(texts.filter(pa.array(letter))))
                    lang[letter], score[letter] = a, p
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(lang, pa.string()), pa.array(score), *([s.column(1)] if carry else [])], names=names)

    return base.mapInArrow(run, with_row(docs, "doc_id long, held_out boolean, lang_pred string, score double", carry))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, learn(docs, per_language))
