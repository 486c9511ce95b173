"""Helpers that several operators share: tables, scratch space, byte-level words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes an Arrow batch may hold when it goes to Python; texts may be long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: The struct column that carries a document's own columns beside an operator's.
ROW = "row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch of long texts far below a worker's memory.

    The limits are session settings, which Spark reads when the query runs; they are only ever lowered.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("b") or 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    Where ``spark.checkpoint.dir`` is unset, a local session gets one of its own; a cluster has no folder to fall back to.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "tidemill-checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete saved tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
            df.scratch_path = None


def fold(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def held_out(mod: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(mod, id_col) == 2, F.lit(False))


def crc_fold(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column, or that of the carried row, as a large_string array with nulls made empty."""
    at = batch.schema.get_field_index(name)
    col = batch.column(at) if at >= 0 else batch.column(ROW).field(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not col.offset and (not len(col) or not int(np.frombuffer(col.buffers()[1], np.int64)[0])):
        return col
    flat, off = raw_bytes(col)  # ascii_lower misreads text buffers that do not begin at 0
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes()))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, n + 1 offsets) of a large_string array without nulls."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return flat, offsets - lo


def byte_class(word: bytes | None = None, *, not_in: bytes | None = None) -> np.ndarray:
    """A 256-entry table of which bytes belong to words."""
    t = np.zeros(256, bool)
    if word is not None:
        t[np.frombuffer(word, np.uint8)] = True
        return t
    t[:] = True
    t[np.frombuffer(not_in, np.uint8)] = False
    return t


#: Words ``[^\x20\x09-\x0D]+``: every byte but the six ASCII spaces.
SPACE_WORDS = byte_class(not_in=b" \t\n\x0b\x0c\r")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_WORDS = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(flat: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per document) of the maximal runs of ``cls`` bytes; runs end at document ends."""
    n_docs = len(offsets) - 1
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    inside = cls[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    got = _POWERS[kind]
    if len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        _POWERS[kind] = got
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from polynomial prefix sums.

    Bytes go through a non-linear table first; blocks bound the temporary arrays.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(ends, lo + block, side="right"))
        to = max(to, at + 1)
        hi = int(ends[to - 1])
        size = hi - lo
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODE[flat[lo:hi]] * _powers("up", _MULT, size), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _powers("down", _INV, size + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(words: list[bytes]) -> np.ndarray:
    """:func:`word_hashes` of given words."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    return word_hashes(flat, starts, ends) if words else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive word hashes (document ends are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * np.uint64(0x9FB21C651E98DF25)
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out += words[j : j + n]
        out *= np.uint64(0x9FB21C651E98DF25)
    return mix64(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def bounded_sample(labelled: DataFrame, klass: str, per_class: int, most_classes: int = 64) -> tuple[DataFrame | None, dict]:
    """(doc_id and class of at most ``per_class`` documents of each class, rows of each class).

    The documents with the smallest hash of doc_id are taken, of the ``most_classes`` most
    frequent classes.  Counts give each class a hash threshold that about twice as many rows
    as needed pass, so one scan filters and only these few rows are ordered.  A document counts
    once for a class, however often it is labelled; with several labels it is in several classes.
    """
    spark = labelled.sparkSession
    top = labelled.groupBy(klass).agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), klass).limit(most_classes).collect()
    counts = {r[0]: r[1] for r in top}
    if not counts:
        return None, {}
    limits = spark.createDataFrame([(r[0], int(min(1.0, (2 * per_class + 50) / max(1, r[2])) * (1 << 62))) for r in top], T.StructType([T.StructField(klass, labelled.schema[klass].dataType), T.StructField("_most", T.LongType())]))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)  # 0 .. 2^62
    few = labelled.select("doc_id", klass, h.alias("_h")).join(F.broadcast(limits), klass).filter("_h <= _most").select("doc_id", klass, "_h").distinct()
    ranked = few.withColumn("_k", F.row_number().over(Window.partitionBy(klass).orderBy("_h", "doc_id")))
    return ranked.filter(F.col("_k") <= per_class).select("doc_id", klass), counts


def with_row(docs: DataFrame, ddl: str, carry: bool) -> T.StructType:
    """The schema of ``ddl``, and the carried row if there is one."""
    out = T.StructType.fromDDL(ddl)
    return out.add(ROW, docs.schema, False) if carry else out


def text_or_row(docs: DataFrame, carry: bool) -> Column:
    """What is sent to Python: the text alone, or the whole row, in one column whose name cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW) if carry else F.col("text")
