"""Projection, comparison filters and the case-insensitive comparator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
}


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in the given order; a repeated one gets a numbered name."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        k = seen[c] = seen.get(c, 0) + 1
        out.append(F.col(c) if k == 1 else F.col(c).alias(f"{c}_{k}"))
    return df.select(*out)


def ignore_case(c: Column) -> Column:
    return F.lower(c.cast("string"))


def filter_equal(df: DataFrame, column: str, value, normal: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Rows whose normalised column equals the normalised value."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    return df.filter(normal(F.col(column)) == normal(F.lit(value)))


def select_where(df: DataFrame, column: str, op: str, value, returns: Sequence[str] | None = None) -> DataFrame:
    """``=`` compares text without case, the others whole numbers; ``*`` as value keeps all.

    What is no number compares as NULL and goes.
    """
    if column not in df.columns or op not in COMPARISONS:
        raise ValueError(f"no such column or comparison: {column}, {op}")
    if value == "*":
        out = df
    elif op == "eq":
        out = filter_equal(df, column, value, ignore_case)
    else:
        out = df.filter(COMPARISONS[op](F.col(column).try_cast("bigint"), F.lit(value).cast("bigint")))
    return project(out, returns) if returns else out


def exclaim(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.concat(F.col(column), F.lit("!!!")))


def union_all(*inputs: DataFrame) -> DataFrame:
    """Fan-in of relations with the same columns."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df)
    return out
