"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Nulls, empty texts,
repeated rows and empty tables are handled as the operators' docstrings say: an
unlabelled empty text scores like any other text, a text without a letter has no
language and goes, rows that repeat a doc_id are one document and stay together,
rows without a doc_id cannot be named as copies and stay, very long texts are read
whole, extra columns, whatever their names, go through to the last stage, and an
empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, langid, neardup, packing, quality
from tidemill.llm.common import ROW, forget, saved, table

#: Below this score a predicted language counts as none.
LEAST_LANGUAGE_SCORE = 0.1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model (operator 10) predicts to be good."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=True)
    return (scored.filter("predicted = 1") if model is not None else scored).select(f"{ROW}.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found (operator 7)."""
    found = langid.predict(docs, langid.learn(docs), carry=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(f"{ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 8)."""
    gone = saved(neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    # a bitmap of bounded size lets most kept documents pass where they lie; only the others are shuffled
    bits = neardup.bitmap(gone)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        h = h.to_numpy()
        return pd.Series((sent.value[h >> 6] >> (h & 63) & 1) == 1)

    mark = marked(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(64 * len(bits))))
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), mark.alias("marked"))
    rest = one.filter("marked").select(ROW, F.col(f"{ROW}.doc_id").cast("long").alias("doc_id")).join(gone, "doc_id", "left_anti").select(ROW)
    return one.filter("not marked").select(ROW).union(rest).select(f"{ROW}.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark text (operator 6)."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("not contaminated").select(f"{ROW}.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (operator 5)."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Models are trained in the first two stages, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
