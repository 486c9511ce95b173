"""Operator 8: near-duplicate documents by HyperMinHash.

A document's set is its distinct ``k``-word shingles (64-bit hashes); a document of
fewer words has its whole sequence as one shingle; without words the set is empty
and is linked with nothing.

1. One pass over the texts gives the size, a fingerprint of the set and the
   HyperMinHash registers: for each of ``BANDS * ROWS`` buckets the minimum hash,
   stored as its leading-zero count and ``MANTISSA`` bits.
2. Texts with equal sets collapse to their smallest doc_id (a partial aggregate).
3. Bands of ``ROWS`` registers are bucket keys.  A pair of similarity 0.8 shares no
   bucket with probability (1 - 0.8 ** ROWS) ** BANDS, about 3e-6.
4. Every member of a bucket is paired with the bucket's smallest member only.  Pairs
   whose collision-corrected estimate is below ``threshold - MARGIN`` (six standard
   errors) go, a pair of similarity 0.8 with probability 1e-8; the rest are confirmed on
   full sets.  Either way such a pair is missed with probability 3.3e-6 at most.
5. Confirmed links give components.  A bucket whose members still lie in several
   components is looked at again: each member outside the leader's component visits
   all blocks of its bucket and is estimated against every member of another
   component, streaming, with one block in memory.  Members that may have such a link
   come back with their sets, and links are confirmed in the block, skipping what the
   block has already joined.  So every pair of a bucket is either compared or already
   connected, and what is written is a row for each member and a tree of links.

Components come from alternating large-star and small-star steps over links, with
each step written to the shared folder.  Nothing is collected to the driver but
counts.

Totals by bucket or node are shuffled once more before they are joined (:func:`_apart`),
so that both sides of such a join are plain shuffles and adaptive execution can split a
hot key.  Scratch tables are deleted as soon as nothing reads them again.

Null doc_ids cannot be named: such rows have a null component and are kept.  Rows
that repeat a doc_id are separate texts with the same name.  Null and empty texts have
an empty set; texts of any length give whole sets, and sets are compared in batches
bounded by bytes; ties need no rule, as the smallest doc_id names a component.  An
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, forget, mix64, ragged, raw_bytes, saved, shingle_hashes, small_batches, text_array, word_hashes, word_spans

BANDS, ROWS, MANTISSA = 24, 4, 10
REGISTERS = BANDS * ROWS
THRESHOLD, MARGIN = 80, 0.25
BLOCK = 1024
#: Most bits of the bitmap that goes to the workers (32 MiB); it has 16 for each id up to that, 64 k at least.
BITS, LEAST_BITS = 1 << 28, 1 << 16
_SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:REGISTERS], _SEEDS[REGISTERS:] | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all distinct shingle hashes, sorted within each text; n + 1 offsets)."""
    flat, off = raw_bytes(texts)
    flat = LOWER[flat]
    starts, ends, per = word_spans(flat, off, SPACE_WORDS)
    words = word_hashes(flat, starts, ends)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    full = shingle_hashes(words, k)
    short = {n: shingle_hashes(words, n) * np.uint64(2) + np.uint64(n) for n in set(per[(per > 0) & (per < k)].tolist())}
    sets = []
    for a, n in zip(first.tolist(), per.tolist()):
        if n >= k:
            s = np.sort(full[a : a + n - k + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(short[n][a : a + 1] if n else full[:0])
    size = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else full[:0], np.concatenate([[0], np.cumsum(size)])


def registers(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros, then mantissa) of non-empty sets, a row each."""
    out = np.empty((len(off) - 1, REGISTERS), np.uint16)
    for j in range(REGISTERS):
        low = np.minimum.reduceat((shingles ^ _XOR[j]) * _MUL[j], off[:-1])
        m, e = np.frexp(low.astype(np.float64) + 1)
        out[:, j] = np.clip(64 - e, 0, 63).astype(np.uint16) << MANTISSA | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets agree."""
    z = np.arange(64)[:, None]
    octave = lambda s: np.exp(-s * 2.0 ** -(z + 1.0)) - np.exp(-s * 2.0 ** -z)
    return (octave(np.asarray(n, float)) * octave(np.asarray(m, float))).sum(0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    c = chance(n, m)
    return ((a == b).mean(-1) - c) / (1 - c)


def likely(est: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs that may reach the threshold: estimate within the margin and sizes that allow it."""
    return (est >= threshold / 100 - MARGIN) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))


def sketch(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), reg of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                s = b.slice(lo, 200)
                sh, off = shingle_sets(text_array(s), k)
                size = np.diff(off)
                some = np.flatnonzero(size)
                f1, f2, reg = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64), [b""] * len(size)
                if len(some):
                    at = np.concatenate([off[:-1][some], off[-1:]])
                    f1[some] = np.add.reduceat(sh * np.uint64(0xFF51AFD7ED558CCD), at[:-1])
                    f2[some] = np.add.reduceat(mix64(sh ^ np.uint64(0xC4CEB9FE1A85EC53)), at[:-1])
                    for i, r in zip(some.tolist(), registers(sh, at)):
                        reg[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(reg, pa.binary())], names=["doc_id", "n", "f1", "f2", "reg"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, reg binary")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A power of two of bits, set at the hashes of the ids (``doc_id``).

    Beyond BITS / 16 ids it lets more other ids pass, which costs shuffled rows and no results.
    """
    n = LEAST_BITS
    while n < min(BITS, 16 * ids.count()):
        n *= 2
    h = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("h")
    words = ids.select(h).groupBy(F.expr("h div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, set (sorted 64-bit hashes) of the documents in ``ids``.

    Texts are not shuffled: a bitmap of the ids, of a fixed size, drops most other
    documents where they lie, and the join drops the rest.
    """
    bits = bitmap(ids)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            h = b.column(2).to_numpy()
            b = b.filter(pa.array(sent.value[h >> 6] >> (h & 63) & 1 == 1))
            for lo in range(0, b.num_rows, 200):
                s = b.slice(lo, 200)
                sh, off = shingle_sets(text_array(s), k)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([sh[x:y].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())], names=["id", "set"])

    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = every.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(64 * len(bits))).alias("h")).mapInArrow(run, "id long, set binary")
    return near.join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi")


def _may_link(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose registers allow a link."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("reg").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("reg").alias("rb"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            ok = pa.array(likely(estimate(ra, rb, n, m), n, m, threshold))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= threshold * (len(both) - inter)


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()
    sets = saved(_sets(docs, ids, k))

    def run(batches):
        for b in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    second = first.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    out = saved(second.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct())
    forget(sets)
    return out


def _apart(totals: DataFrame, key: str) -> DataFrame:
    """Totals whose partitioning by ``key`` the planner does not see, so that a join does not reuse the aggregate's shuffle.

    A join side that is an aggregate keeps a hot key of the other side in one task.
    """
    return totals.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the smallest node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("o"), F.max("i").alias("i")).filter("o > 1 or o + i > 1").isEmpty()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (its smallest reachable node) of every node of the links (a, b)."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most):
        if _are_stars(edges):
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out.scratch_path = edges.scratch_path
            return out
        both = edges.union(edges.select("v", "u"))
        low = _apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _apart(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        old, edges = edges, saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        forget(old)
    raise RuntimeError("components did not settle")


def _meetings(batches, threshold: int):
    """(row of a visitor, home rows it may link with) within each (key, salt), home rows held, visitors streamed.

    Yields (batch, index, held rows, indices of the held rows that may link, first of key and salt).
    """
    at, held, base, fresh = None, [], None, True
    for b in batches:
        rows = b.to_pydict()
        reg = np.frombuffer(b"".join(rows["reg"]), np.uint16).reshape(-1, REGISTERS)
        for i in range(b.num_rows):
            here = (rows["key"][i], rows["salt"][i])
            if here != at:
                at, held, base, fresh = here, [], None, True
            if not rows["visits"][i]:
                held.append({c: v[i] for c, v in rows.items() if c != "reg"} | {"reg": reg[i]})
                continue
            if base is None:
                if not held:
                    continue
                base = {c: np.array([h[c] for h in held]) for c in ("rep", "comp", "n", "stray", "reg")}
            me = rows["rep"][i]
            # pairs with the leader were tried before; two strays meet twice
            ok = np.flatnonzero((base["comp"] != rows["comp"][i]) & (base["rep"] != rows["lead"][i]) & (me != rows["lead"][i]) & (~base["stray"] | (me < base["rep"])))
            if not len(ok):
                continue
            same = base["reg"][ok] == reg[i]
            first = same.reshape(len(ok), BANDS, ROWS).all(2).argmax(1) == rows["band"][i]  # each pair in one bucket only
            n = np.full(len(ok), rows["n"][i])
            c = chance(base["n"][ok], n)
            good = ok[first & likely((same.mean(1) - c) / (1 - c), base["n"][ok], n, threshold)]
            if len(good):
                yield {c: v[i] for c, v in rows.items()}, held, good, fresh
                fresh = False


def _open_buckets(members: DataFrame, reps: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """Rows of the buckets that hold several components: each member at home in one block, strays visiting all blocks."""
    named = members.join(comps, members["rep"] == comps["node"], "left").select("key", "band", "lead", "rep", F.coalesce("comp", "rep").alias("comp"))
    stats = named.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("rep") == F.col("lead"), F.col("comp"))).alias("main")).filter("lo <> hi").select("key", "m", "main")
    stats = _apart(stats, "key")
    open_ = named.join(stats, "key").join(reps, "rep").select("key", "band", "lead", "rep", "comp", "n", "reg", (F.col("comp") != F.col("main")).alias("stray"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    home = open_.select("*", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("salt"), F.lit(False).alias("visits"))
    guest = open_.filter("stray").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(True).alias("visits"))
    columns = ["key", "salt", "visits", "band", "lead", "rep", "comp", "n", "reg", "stray"]
    return saved(home.select(*columns).union(guest.select(*columns)))


def _grouped(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "visits")


def _late_links(rows: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame | None:
    """Links between components that share a bucket: first the members that may have one, then these with their sets."""
    def involved(batches):
        """key, salt, visits, rep of rows with a possible link; a row once for each block."""
        def flush(found):
            cols = list(zip(*found)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64()))], names=["key", "salt", "visits", "rep"])

        seen, out = set(), []
        for me, held, good, fresh in _meetings(batches, threshold):
            if fresh:
                seen = set()
            out.append((me["key"], me["salt"], True, me["rep"]))
            for j in good.tolist():
                if j not in seen:
                    seen.add(j)
                    out.append((me["key"], me["salt"], False, held[j]["rep"]))
            if len(out) > 20_000:
                yield flush(out)
                out = []
        yield flush(out)

    some = saved(_grouped(rows).mapInArrow(involved, "key long, salt int, visits boolean, rep long"))
    if some.isEmpty():
        forget(rows, some)
        return None
    sets = _sets(docs, some.select(F.col("rep").alias("doc_id")).distinct(), k)
    full = rows.join(some, ["key", "salt", "visits", "rep"]).join(sets.select(F.col("id").alias("rep"), "set"), "rep")

    def confirm(batches):
        """a, b of confirmed links; members already joined within the block are not compared again."""
        group: dict[int, int] = {}
        out = []

        def find(x):
            while group.get(x, x) != x:
                x = group[x]
            return x

        for me, held, good, fresh in _meetings(batches, threshold):
            if fresh:
                group = {}
            mine = np.frombuffer(me["set"], np.uint64)
            for j in good.tolist():
                a, b = find(me["comp"]), find(held[j]["comp"])
                if a != b and _linked(mine, np.frombuffer(held[j]["set"], np.uint64), threshold):
                    group[max(a, b)] = min(a, b)
                    out.append((min(me["rep"], held[j]["rep"]), max(me["rep"], held[j]["rep"])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    out = saved(_grouped(full.select(*rows.columns, "set")).mapInArrow(confirm, "a long, b long"))
    forget(rows, some)
    return out


def near_duplicates(docs: DataFrame, k: int = 4, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketches = saved(sketch(docs, k))
    named = sketches.filter("n > 0 and doc_id is not null")
    reps = saved(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("reg").alias("reg"), F.count("*").alias("copies")))
    keys = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("reg", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])).alias("band", "key")
    bands = reps.select("rep", keys)
    buckets = _apart(bands.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("lead")).filter("m > 1").select("key", "lead"), "key")
    members = saved(bands.join(buckets, "key").select("key", "band", "lead", "rep"))
    look_up = reps.select("rep", "n", "reg")
    stars = members.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    likely_pairs = saved(_may_link(stars, look_up, threshold))
    links = _confirm(likely_pairs, docs, k, threshold)
    forget(likely_pairs)
    comps = components(links)
    late = _late_links(_open_buckets(members, look_up, comps, block), docs, k, threshold)
    if late is not None:
        before, comps = comps, components(links.unionByName(late))
        forget(before, late)
    forget(members, links)
    of_rep = reps.filter("copies > 1").select("f1", "f2", F.col("n").alias("_n"), "rep")
    alone = sketches.join(of_rep, (sketches["f1"] == of_rep["f1"]) & (sketches["f2"] == of_rep["f2"]) & (sketches["n"] == of_rep["_n"]), "left")
    base = alone.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("_rep"))
    out = base.join(comps, base["_rep"] == comps["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "_rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
