"""Count windows on streams, with state that pandas functions keep per key.

Arrival order is the ``order`` column within a key; a micro-batch is sorted by it, and
later micro-batches must not hold earlier rows.  A count window over a whole stream (not a
key) needs the stream's order, so there ``key`` is the stream and a stream is one state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequencing import check_window


def _rows(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def tumbling_sum(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """key, block, total of each complete block of ``size`` arrivals of a key; state: rows and sum of the open block."""

    def run(k, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0)
        out = []
        for v in _rows(batches, order)[value].tolist():
            n, total = n + 1, total + int(v)
            if n % size == 0:
                out.append((k[0], n // size - 1, total))
                total = 0
        state.update((n, total))
        yield pd.DataFrame(out, columns=[key, "block", "total"]).astype({"block": "int64", "total": "int64"})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, block bigint, total bigint", "n bigint, total bigint", "append", GroupStateTimeout.NoTimeout)


def tumbling_count_if(df: DataFrame, key: str, order: str, test, size: int) -> DataFrame:
    """key, block, n: rows that ``test`` (a boolean column) holds for in each complete block of ``size`` arrivals of a key."""
    return tumbling_sum(df.withColumn("_hit", F.coalesce(test, F.lit(False)).cast("bigint")), key, order, "_hit", size).withColumnRenamed("total", "n")


def tumbling_product(df: DataFrame, key: str, order: str, cipher: str, size: int, modulus: int) -> DataFrame:
    """key, block, product of the ciphers of each complete block of ``size`` arrivals of a key: their homomorphic sum.

    State: rows and product of the open block.  NULL ciphers count as rows and multiply by one.
    """

    def run(k, batches, state: GroupState):
        n, product = (state.get[0], int(state.get[1])) if state.exists else (0, 1)
        out = []
        rows = _rows(batches, order)
        for c in rows[cipher].tolist() if len(rows) else []:
            n, product = n + 1, product * int(c) % modulus if c is not None else product
            if n % size == 0:
                out.append((k[0], n // size - 1, str(product)))
                product = 1
        state.update((n, str(product)))
        yield pd.DataFrame(out, columns=[key, "block", "product"]).astype({"block": "int64"})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, cipher).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, block bigint, product string", "n bigint, product string", "append", GroupStateTimeout.NoTimeout)


def sliding_group_count(df: DataFrame, key: str, ms: str, order: str, window: int, slide: int, t0: int) -> DataFrame:
    """As the batch operator: for each row, the rows of its key so far, itself included, whose bucket is alive.

    State: a count for each of a key's alive buckets, so at most ``window // slide`` numbers a key.
    """
    cap = check_window(window, slide)

    def run(k, batches, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        out = []
        rows = _rows(batches, order)
        for o, at in zip(rows[order].tolist(), rows[ms].tolist()) if len(rows) else []:
            own = (at - t0) // (slide + 1)
            lowest = max((at - t0 - window) // (slide + 1) + 1, own - (cap - 1))
            held[own] = held.get(own, 0) + 1
            out.append((o, k[0], at, sum(c for b, c in held.items() if lowest <= b <= own)))
            if len(held) > 4 * cap:
                newest = max(held)
                held = {b: c for b, c in held.items() if b > newest - 2 * cap}
        newest = max(held, default=0)
        held = {b: c for b, c in sorted(held.items()) if b > newest - 2 * cap}
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=[order, key, ms, "n"]).astype({"n": "int64"})

    kinds = dict(df.dtypes)
    schema = f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, `{ms}` {kinds[ms]}, n bigint"
    return df.select(key, ms, order).groupBy(key).applyInPandasWithState(run, schema, "buckets array<bigint>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def in_force(df: DataFrame, key: str, order: str, policy: str, value: str) -> DataFrame:
    """Data rows of a merged stream with the value of the last policy row of their key before them (NULL before the first).

    ``policy`` marks policy rows, which are not passed on; state: the value in force.
    """
    columns = [c for c in df.columns if c not in (policy, value)]

    def run(k, batches, state: GroupState):
        now = state.get[0] if state.exists else None
        rows = _rows(batches, order)
        kept = []
        for i, (p, v) in enumerate(zip(rows[policy].tolist(), rows[value].tolist()) if len(rows) else []):
            if p:
                now = None if v is None or v != v else int(v)
            else:
                kept.append((i, now))
        state.update((now,))
        out = rows.iloc[[i for i, _ in kept]][columns].copy() if kept else pd.DataFrame(columns=columns)
        out[value] = pd.array([v for _, v in kept], dtype="Int64")
        yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{value}` bigint"
    return df.groupBy(key).applyInPandasWithState(run, schema, "now bigint", "append", GroupStateTimeout.NoTimeout)


def bounded_group_count(df: DataFrame, stream: str, key: str, order: str, groups: int) -> DataFrame:
    """Running counts by key within each ``stream`` with at most ``groups`` + 1 groups; the oldest-created one goes first.

    Keys are compared without case and shown as first seen.  The order of creation is
    the stream's, so a stream is one state.
    """

    def run(k, batches, state: GroupState):
        names, counts = (list(x) for x in state.get) if state.exists else ([], [])
        at = {n.lower(): i for i, n in enumerate(names)}
        out = []
        rows = _rows(batches, order)
        for o, name in zip(rows[order].tolist(), rows[key].astype(str).tolist()):
            i = at.get(name.lower())
            if i is None:
                names.append(name)
                counts.append(0)
                if len(names) > groups + 1:
                    names.pop(0)
                    counts.pop(0)
                at = {n.lower(): j for j, n in enumerate(names)}
                i = at[name.lower()]
            counts[i] += 1
            out.append((k[0], o, names[i], counts[i]))
        state.update((names, counts))
        yield pd.DataFrame(out, columns=[stream, order, key, "n"]).astype({"n": "int64"})

    kinds = dict(df.dtypes)
    schema = f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, `{key}` string, n bigint"
    return df.groupBy(stream).applyInPandasWithState(run, schema, "names array<string>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def count_window_join(df: DataFrame, key: str, order: str, side: str, size: int) -> DataFrame:
    """key, l_order, r_order: rows of sides ``l`` and ``r`` of one key meet the other side's last ``size`` rows of that key.

    ``size`` counts rows of the key, so state is bounded by it and keys are spread over tasks.
    """

    def run(k, batches, state: GroupState):
        held = dict(zip(("l", "r"), (list(x) for x in state.get))) if state.exists else {"l": [], "r": []}
        out = []
        rows = _rows(batches, order)
        for o, s in zip(rows[order].tolist(), rows[side].tolist()):
            out += [(k[0], o, x) if s == "l" else (k[0], x, o) for x in held["r" if s == "l" else "l"]]
            held[s] = [*held[s], o][-size:]
        state.update((held["l"], held["r"]))
        yield pd.DataFrame(out, columns=[key, "l_order", "r_order"]).astype({"l_order": "int64", "r_order": "int64"})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, l_order bigint, r_order bigint", "l array<bigint>, r array<bigint>", "append", GroupStateTimeout.NoTimeout)


def side_window_join(df: DataFrame, stream: str, key: str, order: str, side: str, size: int) -> DataFrame:
    """key, l_order, r_order: as the batch count-window join, a row meets those of its key among the other *side's* last ``size`` rows.

    The window counts the side's rows whatever their key, so a ``stream`` is one state of at most twice ``size`` rows.
    """

    def run(k, batches, state: GroupState):
        held = {"l": [], "r": []}
        if state.exists:
            lk, lo, rk, ro = state.get
            held = {"l": list(zip(lk, lo)), "r": list(zip(rk, ro))}
        out = []
        rows = _rows(batches, order)
        for name, o, s in zip(rows[key].tolist(), rows[order].tolist(), rows[side].tolist()) if len(rows) else []:
            out += [(name, o, x) if s == "l" else (name, x, o) for other, x in held["r" if s == "l" else "l"] if other == name]
            held[s].append((name, o))
            if len(held[s]) > size:
                del held[s][0]
        state.update(([x for x, _ in held["l"]], [x for _, x in held["l"]], [x for x, _ in held["r"]], [x for _, x in held["r"]]))
        yield pd.DataFrame(out, columns=[key, "l_order", "r_order"]).astype({"l_order": "int64", "r_order": "int64"})

    kind = dict(df.dtypes)[key]
    held = f"lk array<{kind}>, lo array<bigint>, rk array<{kind}>, ro array<bigint>"
    return df.select(stream, key, order, side).groupBy(stream).applyInPandasWithState(run, f"`{key}` {kind}, l_order bigint, r_order bigint", held, "append", GroupStateTimeout.NoTimeout)
