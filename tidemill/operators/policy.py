"""Security policies: latest permissions, policy-driven predicates, tag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.secure import det_encrypt
from .sequencing import _same, bucketed

#: Permissions.
PERMISSIONS = {0: "pln", 1: "RND", 2: "DET", 3: "OPE", 4: "HOM"}


def parse_punctuations(lines: DataFrame) -> DataFrame:
    """stream, permission, provider, field, key of ``SPS,stream,permission,provider,field,key[,...]`` lines."""
    p = F.split("value", ",", -1)
    at = lambda i: F.get(p, F.lit(i))
    ok = lines.filter((at(0) == "SPS") & (F.size(p) >= 6))
    return ok.select(at(1).alias("stream"), at(2).try_cast("int").alias("permission"), at(3).alias("provider"), at(4).alias("field"), at(5).alias("key"))


def split_punctuations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data lines, policy lines): policies never reach data operators."""
    is_policy = F.col("value").contains("SPS")
    return lines.filter(~is_policy), lines.filter(is_policy)


def latest(policies: DataFrame, by: list[str], version: str, values: list[str]) -> DataFrame:
    """The newest value of each group; one partial aggregate."""
    top = policies.groupBy(*by).agg(F.max_by(F.struct(*values), version).alias("_top"))
    return top.select(*by, *[F.col(f"_top.{v}").alias(v) for v in values])


def in_force(data: DataFrame, policies: DataFrame, by: list[str], ts: str, effective: str, value: str) -> DataFrame:
    """Each row with the value of the policy in force at its time (NULL before the first).

    Both inputs are merged in time and the last policy value is carried forward, over the
    border of a time bucket by a table of a row for each key and bucket, so a hot key is many tasks'.
    """
    events = policies.select(*by, F.col(effective).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"), *[F.lit(None).cast(t).alias(f"_d_{c}") for c, t in data.dtypes if c not in by])
    rows = data.select(*by, F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(policies.dtypes)[value]).alias("_value"), *[F.col(c).alias(f"_d_{c}") for c in data.columns if c not in by])
    b = bucketed(events.unionByName(rows), "_at")
    per = b.groupBy(*by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", "_kind"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = per.select(*[F.col(k).alias(f"_b_{i}") for i, k in enumerate(by)], F.col("_bucket").alias("_b_bucket"), earlier.alias("_earlier"))
    w = Window.partitionBy(*by, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_here", F.last("_value", ignorenulls=True).over(w)).filter("_kind = 1")
    merged = local.join(before, _same(by, local, before)).withColumn("_now", F.coalesce("_here", "_earlier"))
    return merged.select(*by, *[F.col(f"_d_{c}").alias(c) for c in data.columns if c not in by], F.col("_now").alias(value))


def permitted(column: Column, permission: Column, plain: Column | None = None) -> Column:
    """The value where the permission is plain (or none is stated), else NULL."""
    return F.when(F.coalesce(permission, F.lit(0)) == 0, column if plain is None else plain)


def tag_counts(df: DataFrame, tags: str, by: list[str] | None = None) -> DataFrame:
    """Records by encryption tag of a space-separated list."""
    each = df.select(*(by or []), F.explode(F.split(tags, " ")).alias("tag"))
    return each.filter(F.col("tag").isin(*PERMISSIONS.values())).groupBy(*(by or []), "tag").agg(F.count("*").alias("n"))


def select_in_force(data: DataFrame, policies: DataFrame, by: list[str], ts: str, effective: str, threshold: str, column: str) -> DataFrame:
    """Rows above the threshold that is in force at their time; all rows while none is.

    A predicate that changes while a stream runs is a versioned table, so results do
    not depend on when an update arrives at an operator.
    """
    now = in_force(data, policies, by, ts, effective, threshold)
    return now.filter(F.col(threshold).isNull() | (F.col(column) > F.col(threshold))).drop(threshold)


def select_equal_in_force(data: DataFrame, policies: DataFrame, by: list[str], ts: str, effective: str, permission: str, column: str, value: str, key: str) -> DataFrame:
    """Rows whose ``column`` equals ``value``, compared as the permission in force at their time allows.

    Plain (or no) permission compares the text, deterministic encryption the value's cipher;
    rows under any other cannot be compared and go.
    """
    now = in_force(data, policies, by, ts, effective, permission)
    return now.filter(equal_by_policy(F.col(column), F.col(permission), value, key)).drop(permission)


def equal_by_policy(column: Column, permission: Column, value: str, key: str) -> Column:
    """The equality test rewritten by a permission; works on streams as well."""
    p = F.coalesce(permission, F.lit(0))
    return F.when(p == 0, column == F.lit(value)).when(p == 2, column == det_encrypt(F.lit(value), key)).otherwise(F.lit(False))


def reveal(data: DataFrame, policies: DataFrame, by: list[str], cipher: str, plain: Column, name: str) -> DataFrame:
    """The decrypted column where the latest permission is plain (or none is stated), else NULL."""
    return data.join(policies.select(*by, F.col("permission").alias("_permission")), by, "left").select(*[c for c in data.columns if c != cipher], permitted(F.col(cipher), F.col("_permission"), plain).alias(name))
