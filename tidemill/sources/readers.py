"""Batch and streaming readers.

Rows with fewer fields than the schema are malformed; they are dropped wherever they
stand (``mode="skip"``) or their missing fields are padded (``mode="pad"``).  Surplus
fields are ignored.  Projection is a ``select``, so it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SEPARATOR = "//$$$//"


def parquet(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def split_fields(line: Column, schema: T.StructType, sep: str, mode: str = "skip", pad: str | None = None) -> tuple[Column, list[Column]]:
    """(condition for well-formed lines, typed columns) of a delimited line."""
    parts = F.split(line, f"\\Q{sep}\\E", -1)
    fields = []
    for i, f in enumerate(schema.fields):
        value = F.get(parts, F.lit(i))
        if mode == "pad" and pad is not None:
            value = F.coalesce(value, F.lit(pad))
        fields.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(f.name))
    ok = F.lit(True) if mode == "pad" else F.size(parts) >= len(schema.fields)
    return ok, fields


def parse(lines: DataFrame, schema: T.StructType, sep: str = "|", columns: Sequence[str] | None = None, mode: str = "skip", pad: str | None = None) -> DataFrame:
    """Typed rows of a DataFrame with one text column ``value``; works on streams."""
    if mode not in ("skip", "pad"):
        raise ValueError(f"unknown mode {mode}")
    missing = set(columns or ()) - set(schema.names)
    if missing:
        raise ValueError(f"not in the schema: {sorted(missing)}")
    ok, fields = split_fields(F.col("value"), schema, sep, mode, pad)
    rows = lines.filter(ok).select(*fields)
    return rows.select(*columns) if columns else rows


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", columns: Sequence[str] | None = None, mode: str = "skip") -> DataFrame:
    """A delimited file or folder in batch."""
    return parse(spark.read.text(path), schema, sep, columns, mode)


def delimited_stream(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", columns: Sequence[str] | None = None, mode: str = "skip", files_per_trigger: int | None = None) -> DataFrame:
    """A folder that grows; ``files_per_trigger`` is the rate limit."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse(reader.load(path), schema, sep, columns, mode)


def socket_stream(spark: SparkSession, host: str, port: int, schema: T.StructType, sep: str = "|", columns: Sequence[str] | None = None, mode: str = "skip", pad: str | None = None) -> DataFrame:
    """Lines of a TCP server (``sep=","``, ``mode="pad"``, ``pad="N/A"`` for ragged CSV)."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return parse(lines, schema, sep, columns, mode, pad)


def records(lines: DataFrame, schema: T.StructType, provider: str | None = None) -> DataFrame:
    """``//$$$//`` records; the last field is a list of encryption tags.  ``provider`` is put before the record."""
    if provider is not None:
        lines = lines.select(F.concat_ws(RECORD_SEPARATOR, F.lit(provider), "value").alias("value"))
    return parse(lines, schema, RECORD_SEPARATOR)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def arrival_ms(seq: Column, rates: Sequence[float], checkpoints: Sequence[float]) -> Column:
    """Arrival time in ms of the 1-based ``seq``-th row of a paced source.

    ``rates[i]`` rows a second hold from ``checkpoints[i]`` seconds on; the last rate
    holds for ever.  A closed form, so replay needs no clock and no single reader.
    """
    if not rates or len(rates) != len(checkpoints) or any(r <= 0 for r in rates):
        raise ValueError("one positive rate for each checkpoint is needed")
    done, out = 0.0, None
    spans = []
    for i, rate in enumerate(rates):
        n = rate * (checkpoints[i + 1] - checkpoints[i]) if i + 1 < len(rates) else float("inf")
        spans.append((done, n, checkpoints[i], rate))
        done += n
    for before, n, start, rate in reversed(spans):
        at = F.lit(start * 1000.0) + (seq - F.lit(before)) * F.lit(1000.0 / rate)
        out = at if out is None else F.when(seq <= F.lit(before + n), at).otherwise(out)
    return F.round(out, 6)


def provider_records(lines: DataFrame, fields: Sequence[str], header: str | None = None, tags: int = 5) -> DataFrame:
    """Records of a data provider: ``{a|b|...}`` lines with up to ``tags`` encryption tags after the fields.

    The header line is dropped wherever a split begins; missing tags are padded with
    ``pln``.  Columns: the fields and ``enc``, the tags joined by spaces.
    """
    body = F.regexp_replace("value", r"^\s*\{|\}\s*$", "")
    p = F.split(body, r"\|", -1)
    n = len(fields)
    tag = [F.coalesce(F.nullif(F.trim(F.get(p, F.lit(n + i))), F.lit("")), F.lit("pln")) for i in range(tags)]
    ok = F.size(p) >= n
    if header is not None:
        ok = ok & (F.trim("value") != F.lit(header))
    return lines.filter(ok).select(*[F.trim(F.get(p, F.lit(i))).alias(f) for i, f in enumerate(fields)], F.concat_ws(" ", *tag).alias("enc"))


def config_rows(lines: DataFrame) -> DataFrame:
    """section, fields of ``section;a,b,c`` configuration lines; others are skipped."""
    p = F.split("value", ";", 2)
    return lines.filter(F.size(p) == 2).select(F.trim(F.get(p, F.lit(0))).alias("section"), F.transform(F.split(F.get(p, F.lit(1)), ","), lambda x: F.trim(x)).alias("fields"))
