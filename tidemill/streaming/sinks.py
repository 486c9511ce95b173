"""Sinks: metric lines, JDBC tables, draining."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def metric_lines(df: DataFrame, path: str) -> None:
    """ts, metric, value lines, one folder a task; rewritten on each call."""
    df.select("task", "ts", "metric", "value").write.mode("overwrite").partitionBy("task").csv(path)


def to_jdbc(url: str, table: str, **options):
    """A ``foreachBatch`` function that appends to a table; credentials come from options only."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

    return write


def from_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Look up a metadata table."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def upsert_jdbc(url: str, table: str, keys: list[str], **options):
    """A ``foreachBatch`` function that updates rows of equal keys and inserts the others.

    For metadata tables: the whole table is read, merged and loaded again with truncation.
    """

    def write(batch: DataFrame, epoch: int = 0) -> None:
        old = from_jdbc(batch.sparkSession, url, table, **options)
        new = batch.select(*old.columns)
        merged = old.join(new, keys, "left_anti").select(*old.columns).unionByName(new)
        load_jdbc(merged, url, table, **options)

    return write


def load_jdbc(rows: DataFrame, url: str, table: str, **options) -> None:
    """Truncate a metadata table and load it; rows are read before the table is emptied."""
    kept = rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)
    kept.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()


def load_config(config: DataFrame, url: str, **options) -> None:
    """Load the tables that a configuration (``readers.config_rows``) names: one row for each field, numbered from 0.

    ``provider`` and ``attribute`` lists become (id, name); ``policy`` fields ``id:a:b`` become (provider_id, policy).
    """
    each = config.select("section", F.posexplode("fields").alias("id", "field"))
    named = lambda s: each.filter(F.col("section") == s).select("id", F.col("field").alias("name"))
    p = F.split("field", ":")
    policies = each.filter((F.col("section") == "policy") & (F.size(p) >= 3)).select(F.get(p, F.lit(0)).try_cast("int").alias("provider_id"), F.concat_ws(",", F.get(p, F.lit(1)), F.get(p, F.lit(2))).alias("policy"))
    for rows, table in ((named("provider"), "data_provider"), (policies, "policy"), (named("attribute"), "attribute")):
        load_jdbc(rows, url, table, **options)


def drain(df: DataFrame):
    """Run a stream and discard its rows."""
    return df.writeStream.format("noop").start()


class ProgressLog(StreamingQueryListener):
    """Progress of streams as JSON lines (rates, state rows and bytes, durations), handed to ``write`` at most every ``every`` seconds."""

    def __init__(self, write, every: float = 1.0):
        self._write, self._every, self._last = write, every, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        now = time.monotonic()
        if now - self._last < self._every:
            return
        self._last = now
        p = event.progress
        state = [{"rows": s.numRowsTotal, "bytes": s.memoryUsedBytes} for s in p.stateOperators]
        self._write(json.dumps({"ts": p.timestamp, "name": p.name, "batch": p.batchId, "input_rate": p.inputRowsPerSecond, "throughput": p.processedRowsPerSecond, "duration_ms": dict(p.durationMs), "state": state}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
