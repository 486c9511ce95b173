"""Operator 1: language-model scoring with a causal self-attention model on subword ids.

The text a model sees is its words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, each encoded
with a single space before it, then one end.  Frequent byte-level BPE ids are classes;
the others share an escape class and an add-one unigram.  Documents whose crc32 fold is 2 are
held out of all learning.

Passes:

1. over the training texts: word counts (by 64-bit hash), aggregated in Spark;
2. over all texts, once: ids, the counts of known words and what the base score needs,
   written to the shared folder.  No later pass reads a text;
3. over the ids of all training documents: id counts, from which the classes are
   chosen, then class bigrams;
4. a round for each of ``RATES``.  The rounds deal the training documents out among
   them, so that each is learned from once.  A round's documents are dealt by hash to
   shards of about ``SHARD_DOCS``; a shard's model starts from the common weights and
   reads the shard in the order of ids, and the weights of all shards are averaged by
   tokens, in steps of bounded fan-in.  Shards depend on the documents alone, so the
   model does not depend on files, partitions or executors;
5. over all ids: scores.  Overlapping windows, batched, with a mask so that every token
   is scored once.  (Training windows need not overlap: each token is a target once.)

The add-one word unigram (the base score) needs each word's count.  Words with at
least ``N / HOT`` occurrences - at most HOT of them, whatever the corpus - go to the
workers; occurrences of other words are joined with the counts by hash, with each
text's repeats summed first.

Null and empty texts have the end only.  Rows are told apart by their place, so
repeated doc_ids and null doc_ids are scored like any others (a null doc_id is
neither held out nor learned from).  Texts of any length are read whole; equal counts
are ordered by id.  An empty table gives no rows; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import LOWER, SPACE_WORDS, fold, held_out, ragged, raw_bytes, saved, small_batches, text_array, word_hashes, word_spans
from .tokens import load_bpe

MOD, HOT = 7, 1 << 20
#: Documents of a training shard, ids that it holds at a time, and windows of a step.
SHARD_DOCS, HELD_IDS, STEP = 2048, 1 << 18, 128
#: Learning rates of the rounds.
RATES = (3e-3, 1e-3)
ESCAPE, END = attention.CLASSES - 2, attention.CLASSES - 1
KEPT_IDS = attention.CLASSES - 2
BATCH = 256


def normal_texts(texts: pa.Array) -> pa.Array:
    """Lower-cased words, each after a single space."""
    flat = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\x20\x09-\x0D]+", " ")
    flat = pc.ascii_trim(flat, characters=" ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(pc.equal(flat, none), flat, pc.binary_join_element_wise(space, flat, none))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends and hashes of the words, words per text)."""
    flat, off = raw_bytes(texts)
    flat = LOWER[flat]
    starts, ends, per = word_spans(flat, off, SPACE_WORDS)
    return flat, starts, ends, word_hashes(flat, starts, ends), per


def word_hash_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text)."""
    *_, hashes, per = words_of(texts)
    return hashes.view(np.int64), per


class Vocabulary:
    """Classes of BPE ids, and what escapes cost."""

    def __init__(self, ids: np.ndarray, size: int):
        self.kept = ids[:KEPT_IDS]
        self.of = np.full(size, ESCAPE, np.int64)
        self.of[self.kept] = np.arange(len(self.kept))
        self.tail = np.zeros(size)

    def set_tail(self, counts: np.ndarray) -> None:
        rare = np.where(self.of == ESCAPE, counts, 0)
        self.tail = np.where(self.of == ESCAPE, np.log((rare + 1) / (rare.sum() + max(1, (self.of == ESCAPE).sum()))), 0.0)

    def classes(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with an END after each text, and the offsets of that."""
        return np.insert(self.of[ids], off[1:], END), off + np.arange(len(off))


@functools.lru_cache(maxsize=1)
def _single_thread() -> None:
    """One BLAS thread for each task: numpy is loaded already, so its library is told."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            f = getattr(ctypes.CDLL(path), name, None)
            if f:
                f(1)


def _slices(batches, rows: int = 1000):
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & (fold(MOD) != 2))


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _ids_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets) of a column of encoded documents."""
    return _joined(column.to_pylist(), size)


def _joined(rows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(_id_type(size))
    off = np.cumsum([0, *map(len, rows)]) // kind.itemsize
    return np.frombuffer(b"".join(rows), kind), off


def _id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id in all training texts."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in _slices(batches):
            total += np.bincount(_ids_of(b.column(0), size)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    # at most one row for each id of the vocabulary
    rows = encoded.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy()] = rows["c"].to_numpy()
    return out


def _top_ids(counts: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(counts)), -counts))[:KEPT_IDS]
    return order[counts[order] > 0]


def _word_counts(train: DataFrame) -> DataFrame:
    """key (word hash), c over all training texts."""

    def run(batches):
        for b in _slices(batches):
            key, c = np.unique(word_hash_rows(text_array(b))[0], return_counts=True)
            for lo in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000]), pa.array(c[lo : lo + 100_000].astype(np.int64))], names=["key", "c"])

    return train.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _pair_counts(encoded: DataFrame, vocab: Vocabulary, size: int) -> np.ndarray:
    """Class pairs of all training texts, by previous class and class."""

    def run(batches):
        pairs = np.zeros(attention.CLASSES**2, np.int64)
        for b in _slices(batches):
            s, _ = vocab.classes(*_ids_of(b.column(0), size))
            prev = np.concatenate([[END], s[:-1]])
            pairs += np.bincount(prev * attention.CLASSES + s, minlength=len(pairs))
        at = np.flatnonzero(pairs)
        for lo in range(0, len(at), 100_000):
            k = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(pairs[k])], names=["key", "c"])

    # bounded by the square of the classes
    rows = encoded.select("ids").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(attention.CLASSES**2, np.int64)
    out[rows["key"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(attention.CLASSES, -1)


def _train_round(chosen: DataFrame, k: int, rate: float, least: int, weights: np.ndarray, vocab: Vocabulary, tables, size: int, shards: int, fan_in: int = 64) -> np.ndarray:
    """Weights averaged over the shards' training on the documents of round ``k`` (shard, doc_id, ids).

    A shard learns from each of its documents once, and again until it has made ``least`` steps.
    """
    spark = chosen.sparkSession
    sent = spark.sparkContext.broadcast((weights, vocab, tables))

    class Shard:
        def __init__(self, number, start):
            self.model, self.rng = attention.Adam(start, rate), np.random.default_rng([k, number])
            self.rows, self.held, self.seen, self.kept, self.n_kept = [], 0, 0, [], 0

        def learn(self, x, y, mask):
            order = self.rng.permutation(len(x))
            for lo in range(0, len(order), STEP):
                w = order[lo : lo + STEP]
                self.model.step(attention.gradient(self.model.flat, sent.value[2], x[w], y[w], mask[w]))

        def flush(self):
            s, so = sent.value[1].classes(*_joined(self.rows, size))
            x, y, mask, _ = attention.windows(s, so, END, overlap=0)
            self.learn(x, y, mask)
            self.seen += len(s)
            if self.n_kept < STEP * least:
                self.kept.append((x, y, mask))
                self.n_kept += len(x)
            self.rows, self.held = [], 0

        def done(self):
            if self.rows:
                self.flush()
            while self.model.t < least:
                self.learn(*(np.concatenate(t) for t in zip(*self.kept)))
            w = (self.model.flat * np.float64(self.seen)).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([self.seen], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])

    def local(batches):
        _single_thread()
        at, shard = None, None
        for b in batches:
            for number, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if number != at:
                    if shard:
                        yield shard.done()
                    at, shard = number, Shard(number, sent.value[0])
                shard.rows.append(ids)
                shard.held += len(ids)
                if shard.held >= HELD_IDS:
                    shard.flush()
        if shard:
            yield shard.done()

    def total(batches):
        n, w = 0, 0.0
        for b in batches:
            for m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, w = n + m, w + np.frombuffer(x, np.float32).astype(np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = chosen.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "doc_id", F.xxhash64("ids"))
    got = dealt.select("shard", "ids").mapInArrow(local, "n long, w binary")
    while parts > fan_in:  # a shuffle, so that training keeps its tasks
        parts = -(-parts // fan_in)
        got = got.repartition(parts).mapInArrow(total, "n long, w binary")
    rows = got.collect()  # at most fan_in rows, or shards
    n = sum(r[0] for r in rows)
    return (sum(np.frombuffer(r[1], np.float32).astype(np.float64) for r in rows) / n).astype(np.float32) if n else weights


def score(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", rates: tuple[float, ...] = RATES, least_steps: int = 0, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = _training(docs)
    size = len(load_bpe(tokenizer).lengths)
    kind = _id_type(size)
    n_train = train.count()
    words = saved(_word_counts(train))
    n_words, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)
    # at most ``hot`` words reach the threshold
    few = words.filter(F.col("c") >= max(1, -(-total // hot))).toArrow()
    order = np.argsort(few["key"].to_numpy())
    hot_sent = sc.broadcast((few["key"].to_numpy()[order], np.log10(few["c"].to_numpy()[order] + 1.0)))

    def measure(batches):
        bpe = load_bpe(tokenizer)
        hot_key, hot_log = hot_sent.value
        place = TaskContext.get().partitionId() << 33
        for b in _slices(batches, 500):
            texts, n = text_array(b), b.num_rows
            own = place + np.arange(n)
            place += n
            flat, starts, ends, h, per = words_of(texts)
            doc = np.repeat(np.arange(n), per)
            distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
            h, signed = h.view(np.int64), distinct.view(np.int64)
            at = np.minimum(np.searchsorted(hot_key, signed), max(0, len(hot_key) - 1))
            is_hot = (hot_key[at] == signed if len(hot_key) else np.zeros(len(signed), bool))[which]
            base = np.bincount(doc[is_hot], hot_log[at[which[is_hot]]] if len(hot_key) else None, n)
            known = np.bincount(doc[is_hot], minlength=n)
            pool, begin, size_of = bpe.encode_words(flat, starts[first], ends[first], distinct)
            each = size_of[which]
            ids = pool[ragged(begin[which], each)].astype(kind)
            off = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(per))]
            rows = pa.array([ids[x:y].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), b.column(2), b.column(3), b.column(4), pa.array(per + 1), pa.array(known), pa.array(base.astype(np.float64)), rows, none, none], names=names)
            rare, rd = h[~is_hot], doc[~is_hot]
            order = np.lexsort((rare, rd))
            rare, rd = rare[order], rd[order]
            first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rd[1:] != rd[:-1])])) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(rare)))
            for lo in range(0, len(first), 50_000):
                f = first[lo : lo + 50_000]
                void = [pa.nulls(len(f), t) for t in (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(own[rd[f]]), *void, pa.array(rare[f]), pa.array(times[lo : lo + 50_000])], names=names)

    names = ["row", "doc_id", "held_out", "round", "shard", "n_tokens", "known", "base", "ids", "key", "times"]
    schema = "row long, doc_id long, held_out boolean, round int, shard long, n_tokens long, known long, base double, ids binary, key long, times long"
    shards = max(1, n_train // (len(rates) * SHARD_DOCS))
    learned = F.col("doc_id").isNotNull() & (fold(MOD) != 2)
    deal = lambda seed, n: F.when(learned, F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n)))
    columns = ["doc_id", "text", held_out(MOD).alias("held_out"), deal(17, max(1, len(rates))).cast("int").alias("round"), deal(19, shards).alias("shard")]
    parts = saved(docs.select(*columns).mapInArrow(measure, schema))
    whole = parts.filter("ids is not null").drop("key", "times")
    encoded = whole.filter("round is not null").select("round", "shard", "doc_id", "ids")
    id_counts = _id_counts(encoded, size)
    vocab = Vocabulary(_top_ids(id_counts), size)
    vocab.set_tail(id_counts)
    tables = attention.tables_of(_pair_counts(encoded, vocab, size))
    weights = attention.initial()
    for k, rate in enumerate(rates):
        weights = _train_round(encoded.filter(F.col("round") == k), k, rate, least_steps, weights, vocab, tables, size, shards)
    sent = sc.broadcast((weights, vocab, tables))

    def run(batches):
        _single_thread()
        weights, vocab, tables = sent.value
        p = attention.unpack(weights)
        ready = attention.projected(p)
        for b in _slices(batches, 500):
            ids, off = _ids_of(b.column(0), size)
            s, so = vocab.classes(ids, off)
            x, y, mask, text = attention.windows(s, so, END)
            begins = mask[:, 0]  # windows that begin a text; the others' first places are context only
            lp = np.add.reduceat(np.append(vocab.tail[ids], 0.0), off[:-1]) * (off[1:] > off[:-1])
            for w in (w[lo : lo + BATCH] for w in (np.flatnonzero(begins), np.flatnonzero(~begins)) for lo in range(0, len(w), BATCH)):
                got = attention.log_probs(p, tables, x[w], y[w], mask[w], ready)
                lp += np.bincount(np.repeat(text[w], mask[w].sum(1)), got, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lp / math.log(10))], names=[*kept, "score"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]
    scored = saved(whole.select("ids", *kept).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"))
    rare = parts.filter("key is not null").select("row", "key", "times").join(words, "key")
    rare = rare.groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_base"))
    end_log = math.log10(n_train + 1)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) + (1 if n_train else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score",
    )
