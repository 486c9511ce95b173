"""Operator graphs as edge lists (parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "parent string, child string"


def parse(spark: SparkSession, text: str) -> DataFrame:
    """Edges of ``parent:child,child;parent:...``; a node without children has none."""
    rows = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        parent, _, children = part.partition(":")
        rows += [(parent.strip(), c.strip() or None) for c in children.split(",")]
    return spark.createDataFrame(rows, EDGES)


def serialise(edges: DataFrame) -> str:
    rows = edges.groupBy("parent").agg(F.concat_ws(",", F.sort_array(F.collect_set("child"))).alias("c")).orderBy("parent").collect()
    return ";".join(f"{r.parent}:{r.c}" for r in rows)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("parent", "child")).alias("task")).filter("task is not null").distinct()


def inverse(edges: DataFrame) -> DataFrame:
    """task, parents (sorted, comma-joined; empty for roots)."""
    up = edges.filter("child is not null").groupBy(F.col("child").alias("task")).agg(F.concat_ws(",", F.sort_array(F.collect_set("parent"))).alias("parents"))
    return nodes(edges).join(up, "task", "left").select("task", F.coalesce("parents", F.lit("")).alias("parents"))


def layers(edges: DataFrame) -> DataFrame:
    """parents, children, tasks: interior tasks with the same neighbours."""
    down = edges.filter("child is not null").groupBy(F.col("parent").alias("task")).agg(F.concat_ws(",", F.sort_array(F.collect_set("child"))).alias("children"))
    inner = inverse(edges).filter("parents <> ''").join(down, "task")
    return inner.groupBy("parents", "children").agg(F.concat_ws(",", F.sort_array(F.collect_list("task"))).alias("tasks"))


def expand_tasks(edges: DataFrame, copies: DataFrame) -> DataFrame:
    """Physical edges ``name:k`` of logical ones; ``copies`` has (task, n)."""
    p = copies.select(F.col("task").alias("parent"), F.explode(F.sequence(F.lit(1), "n")).alias("pk"))
    c = copies.select(F.col("task").alias("child"), F.explode(F.sequence(F.lit(1), "n")).alias("ck"))
    return edges.join(p, "parent").join(c, "child").select(F.concat_ws(":", "parent", "pk").alias("parent"), F.concat_ws(":", "child", "ck").alias("child"))


def minimal_active(edges: DataFrame) -> DataFrame:
    """task of sources, sinks and the first task of each layer."""
    ends = inverse(edges).join(edges.filter("child is not null").select(F.col("parent").alias("task")).distinct().withColumn("_has", F.lit(True)), "task", "left")
    outer = ends.filter("parents = '' or _has is null").select("task")
    return outer.union(layers(edges).select(F.get(F.split("tasks", ","), F.lit(0)).alias("task"))).distinct()
