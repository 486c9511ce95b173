r"""Operator 2: quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts are taken over the whole text (words ``[^\x20\x09-\x0D]+``): characters in
words, symbols, repeated lines, words inside repeated 5-word windows.  Windows are
compared by 64-bit hashes within a document.

:data:`RULES` turns counts into whole-number rates.  A rule rejects above its
cutoff.  Per stratum (language) and rule, a cutoff of :data:`GRID` is *safe* if the
exact binomial test on labelled good documents bounds its false rejection rate by
``ALPHA / rules`` at level ``DELTA``, Bonferroni-corrected for all strata, rules and
cutoffs.  Of the safe cutoffs the one that rejects most bad per good is used, the
loosest in a tie; a rule without a safe and useful cutoff is off in that stratum.
So, with probability 1 - DELTA, no stratum loses more than ALPHA of its good
documents to the rules.

Null texts are empty: no words, so they fail the base rule.  Texts of any length are
measured whole, a text in one task.  Null and empty languages are one stratum.  Labels
that repeat a document count as often; of cutoffs with equal gain the loosest is used;
repeated rows are judged like any others.  Extra columns, whatever their names, are
ignored; empty tables give no rows; without labels all rules are off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
ALPHA, DELTA, COST = 0.02, 0.1, 5
#: Whole-number rates by rule: permille of word characters, lines or words.
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}
GRID = (10, 20, 40, 60, 80, 100, 150, 200, 300, 400, 600, 800)
NO_CUTOFF = 1001
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _window_hashes(words: Column) -> Column:
    # ``words`` are hashes already, so that each word's bytes are read once
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(5)])
    return F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), at)).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document; one narrow projection after another."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda x: x.rlike(WORD)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
    hashed = F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    d = d.select("doc_id", "lang", "t", hashed.alias("w"), F.filter(F.split("t", "\n", -1), has_word).alias("l"))
    d = d.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.size("l").cast("long").alias("n_lines"),
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), UPPER))).cast("long").alias("n_upper"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), _window_hashes(F.col("w")).alias("h"),
    )
    counts = ["doc_id", "lang", "n_words", "n_lines", "word_chars", "n_symbols", "n_upper", "n_dup_lines"]
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    d = d.select(*counts, F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none).alias("s"))
    s = F.col("s")
    twice = F.filter(s, lambda x, j: (x["x"] == F.get(s, j + 1)["x"]) | (x["x"] == F.get(s, j - 1)["x"]))
    d = d.select(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    p = F.col("p")
    covered = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
    return d.select(*counts, F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X ~ Bin(n, p), by the ratio of neighbouring terms in logarithms."""
    first = f"struct({n} * ln(1 - {p}D) as t, exp({n} * ln(1 - {p}D)) as s)"
    term = f"a.t + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D))"
    return f"if({k} < 1, exp({n} * ln(1 - {p}D)), aggregate(sequence(1L, greatest({k}, 1L)), {first}, (a, i) -> struct({term} as t, a.s + exp({term}) as s), a -> a.s))"


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """lang and one cutoff for each rule; rows of labelled strata only."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    rates = measured.filter(~base_failed()).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), *[F.expr(e).alias(r) for r, e in RULES.items()]).join(good, "doc_id")
    # counts above each cutoff: a rate's place in the grid, then one partial aggregate
    over = [F.sum(F.when((F.col(r) > g) & (F.col("quality") == q), 1).otherwise(0)).alias(f"{r}_{g}_{q}") for r in RULES for g in GRID for q in (0, 1)]
    sums = rates.groupBy("lang").agg(F.sum("quality").cast("long").alias("n1"), F.sum(1 - F.col("quality")).cast("long").alias("n0"), *over)
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(g).alias("cut"), F.col(f"{r}_{g}_1").alias("k1"), F.col(f"{r}_{g}_0").alias("k0")) for r in RULES for g in GRID])).alias("c")
    p = alpha / len(RULES)
    strata = F.count("*").over(Window.partitionBy(F.lit(0))).alias("strata")  # one row for each language
    tests = sums.select("*", strata).select("lang", "n1", "n0", "strata", cells).select("lang", "n1", "n0", "strata", "c.*")
    level = F.lit(delta) / (F.col("strata") * (len(RULES) * len(GRID)))
    # above the mean the tail is over one half, so it need not be summed
    tail = F.expr(f"if(k1 > {p}D * n1, 1D, {binomial_tail('k1', 'n1', p)})")
    gain = F.col("k0") * F.col("n1") - COST * F.col("k1") * F.col("n0")
    safe = tests.filter((tail <= level) & (gain > 0)).select("lang", "rule", "cut", gain.alias("gain"))
    best = safe.groupBy("lang", "rule").agg(F.max(F.struct("gain", "cut"))["cut"].alias("cut"))
    return best.groupBy("lang").agg(*[F.coalesce(F.min(F.when(F.col("rule") == r, F.col("cut"))), F.lit(NO_CUTOFF)).alias(f"cut_{r}") for r in RULES])


def apply(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Counts, base_failed and kept.  ``cuts`` has a row for each labelled language with a safe cutoff, so it is small."""
    joined = measured.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(F.broadcast(cuts.withColumnRenamed("lang", "_lang")), "_lang", "left")
    over = F.lit(False)
    for r, e in RULES.items():
        over = over | (F.expr(e) > F.coalesce(f"cut_{r}", F.lit(NO_CUTOFF)))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One pass over the texts; the small table of counts is written once and read twice."""
    measured = saved(measure(docs))
    return apply(measured, cutoffs(measured, labels, alpha, delta))
