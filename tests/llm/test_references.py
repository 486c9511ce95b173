"""The learned operators against plain loops, and odd tables against every operator."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ahocorasick")

from tidemill.llm import attention, decontaminate, langid, lm, neardup, packing, quality, rules, tokens, toxicity  # noqa: E402

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def naive_measure(lex, text):
    """Every term and phrase by its own search over the folded text."""
    f = toxicity.folded(text)
    find = lambda t: [m.start() for m in re.finditer(f"(?={re.escape(t)})", f)]
    safe = [(a, a + len(p)) for p in lex.exceptions for a in find(p)]
    best = {}
    for term, w in lex.weights.items():
        for a in find(term):
            if not any(x <= a and a + len(term) <= y for x, y in safe):
                best[a] = max(w, best.get(a, 0.0))
    total, n = sum(best.values()), len(best)
    words = f.split()
    for stem, w in lex.dense.items():
        c = sum(x.startswith(stem[1:]) for x in words)
        if c >= 2 and c * toxicity.DENSE >= len(words):
            total, n = total + w, n + 1
    return total, n


@pytest.mark.parametrize("seed", range(30))
def test_matches_equal_plain_searches(seed):
    rng = random.Random(seed)
    syllables = ["ba", "bo", "B0", "bа", "né", "ri", "x", "!", "​", " ", ", ", "2", "ba bo "]
    lex = toxicity.Lexicon({" babo ": 2.0, " bab": 1.5, " ne": 0.5, " bo ": 3.0}, [" ba bo ", " bo bo ", " babo bo "], np.zeros(4), {" ri": 1.0, " x": 0.25})
    for _ in range(20):
        t = "".join(rng.choice(syllables) for _ in range(rng.randint(0, 80)))
        total, n, _ = lex.measure(t)
        assert (pytest.approx(total), n) == naive_measure(lex, t)


def test_folding_reaches_through_disguises():
    assert toxicity.folded("m​o‍r0n MÖRÓN möron 𝐱").split()[:3] == ["moron"] * 3


def test_long_texts_take_linear_time():
    import time

    lex = toxicity.Lexicon({" clown ": 2.0}, [" clown fish "], np.zeros(4))
    took = []
    for n in (20_000, 80_000):
        t = "clown fish clown 1111 " * n
        start = time.perf_counter()
        assert lex.measure(t)[1] == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0]
    bpe = tokens.load_bpe("byte_bpe_50k.json")
    t = "".join(random.Random(1).choices(["foo", "bar,", "x1.", "Qux;", "12", "'s", "é"], k=400_000))
    start = time.perf_counter()
    whole = len(bpe.encode(t))
    alone = time.perf_counter() - start
    assert bpe.count(t) == whole and time.perf_counter() - start < 8 * alone + 1


def test_places_between_tokens_are_proven():
    """Whatever stands around, the pre-tokenizer's matches never go over a proven place."""
    regex = pytest.importorskip("regex")
    pattern = regex.compile(tokens.BYTE_LEVEL_PATTERN)
    alphabet = [" ", "\n", "\t", "a", "s", "T", "é", "日", "1", "२", "'", ".", "€", " ", "　", "ſ", "ll", "'s", "'ll", "́", "²"]
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 12)))
        edges = {m.end() for m in pattern.finditer(t)}
        places = {m.start() for m in tokens._SPLITS.finditer(t.translate(tokens._KINDS))}
        assert places <= edges | {0}


def test_short_runs_use_powers_of_two():
    places = np.array([0, 512, 1024, 1536])
    cuts = packing.best_cuts(places, np.zeros(4), 2048)
    assert all((n := int(places[b] - places[a])) & (n - 1) == 0 for a, b in zip(cuts, cuts[1:]))


def test_votes_equal_plain_duels():
    rng = np.random.default_rng(5)
    names, x = ["aa", "bb", "cc", "dd"], rng.normal(size=(60, 6)).astype(np.float32)
    machines = {(a, b): rng.normal(size=7).astype(np.float32) for i, a in enumerate(names) for b in names[i + 1 :]}
    got, score = langid.LanguageModel._vote(x, names, machines)
    for row, k, p in zip(x, got, score):
        wins, sums, margins = collections.Counter(), collections.Counter(), collections.defaultdict(list)
        for (a, b), w in machines.items():
            m = float(row @ w[:-1] + w[-1])
            wins[a if m > 0 else b] += 1
            for name, s in ((a, m), (b, -m)):
                sums[name] += math.tanh(s)
                margins[name].append(s)
        best = max(names, key=lambda n: wins[n] + sums[n] / 16)
        assert names[k] == best and p == pytest.approx(1 / (1 + math.exp(-3 * min(margins[best]))), rel=1e-4)


def test_trigrams_equal_plain_counts():
    texts = ["The cat, the CAT!", "éa b", "  x ", "日本語 abc", ""]
    got = langid.features(pa.array(texts, pa.large_string()), 2048)

    def slot(a, b, c):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        return ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - 11)

    for row, t in zip(got, texts):
        letters = [c if 0x61 <= (c := b + 32 if 65 <= b <= 90 else b) <= 0x7A or c >= 0x80 else 32 for b in t.encode()]
        counts = collections.Counter(slot(*w) for w in zip(letters, letters[1:], letters[2:]) if w[:2] != (32, 32))
        norm = math.sqrt(sum(counts.values())) or 1
        assert np.allclose(row, [math.sqrt(counts[i]) / norm for i in range(2048)], atol=1e-5)


def naive_features(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, size = max(1, len(w)), max(1, len(t.encode()))
    lines = [x for x in t.split("\n") if x]
    share = lambda chars: sum(c in chars for c in t) / size
    out = [math.log1p(len(w)), sum(len(x.encode()) for x in w) / n, sum(len(x.encode()) > 12 for x in w) / n, share("#*$%&|<>"), share("|"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:?\"'()-"), share("!")]
    if not w:
        return [*out, 0, 0, 0, 0, 0, 0, share("\n")]
    counts = collections.Counter(w)
    triples = list(zip(w, w[1:], w[2:]))
    first = dict.fromkeys(lines)
    return [
        *out, 1 - len(counts) / len(w), max(counts.values()) / len(w), 1 - sum(len(x.encode()) for x in first) / sum(len(x.encode()) for x in lines), math.log1p(len(w) / len(lines)),
        sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) <= 2 for x in lines) / len(lines), (len(triples) - len(set(triples))) / (len(triples) - 1) if len(w) > 3 else 0, share("\n"),
    ]


def test_quality_features_and_tables_equal_plain_loops():
    rng = random.Random(4)
    texts = ["", " ", "one", "a b c d a b c", *("".join(rng.choice(["ab", "Cd ", " ", "\n", "é ", "|", "12 ", "!", ". ", "longlonglonglong ", "x y z "]) for _ in range(rng.randint(1, 90))) for _ in range(60))]
    got = quality.features(pa.array(texts, pa.large_string()))
    for row, t in zip(got, texts):
        assert np.allclose(row, naive_features(t), atol=1e-9), t
    model = quality.AdditiveModel.fit(got, np.arange(len(texts)) % 2.0, np.ones(len(texts)), bins=6, rounds=5, n_pairs=2, pair_rounds=3)
    for row, s in zip(got, model.score(got)):
        b = [sum(x >= c for c in cuts) for x, cuts in zip(row, model.cuts)]
        raw = model.base + sum(t[i] for t, i in zip(model.tables, b)) + sum(t[model.coarse[j][b[j]], model.coarse[k][b[k]]] for (j, k), t in model.pairs.items())
        assert s == pytest.approx(1 / (1 + math.exp(-raw)))


def test_model_probabilities_equal_plain_loops():
    """One window, position by position and head by head, in doubles."""
    rng = np.random.default_rng(8)
    flat = rng.normal(0, 0.3, attention.SIZE).astype(np.float32)
    p = {k: v.astype(float) for k, v in attention.unpack(flat).items()}
    c = attention.CLASSES
    tables = attention.tables_of(rng.integers(0, 3, (c, c)))
    x, y = rng.integers(0, c, (2, 1, attention.LENGTH))
    got = attention.log_probs(attention.unpack(flat), tables, x, y, np.ones(x.shape, bool))
    dh = attention.WIDTH // attention.HEADS
    for i in range(attention.LENGTH):
        mixed = []
        for j in range(attention.HEADS):
            part = slice(j * dh, (j + 1) * dh)
            q = (p["e"][x[0, i]] @ p["q"])[part]
            w = np.array([math.exp(q @ (p["e"][x[0, k]] @ p["k"])[part] / math.sqrt(dh) + p["r"][j, i - k]) for k in range(i + 1)])
            mixed.append(sum(a * (p["e"][x[0, k]] @ p["v"])[part] for k, a in enumerate(w / w.sum())))
        u = p["e"][x[0, i]] + np.concatenate(mixed) @ p["o"]
        h = u + np.maximum(0, u @ p["w1"] + p["b1"]) @ p["w2"]
        g, m = divmod(int(y[0, i]), attention.MEMBERS)
        lg = h @ p["g"] + tables[0][x[0, i]]
        lm_ = h @ p["m"][g] + tables[1][x[0, i], g]
        want = lg[g] - math.log(np.exp(lg).sum()) + lm_[m] - math.log(np.exp(lm_).sum())
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_model_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") for _ in range(30)), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, DDL)
    a, b = ({r.doc_id: r.score for r in lm.score(df.repartition(n), hot=8).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-4) for i in a)


CLASHES = "score double, predicted int, held_out boolean, lang_pred string, row string, n_hit int, items string, contaminated string, spans string, _text string, key bigint, f1 int, rep int, marked string, ids string, n_words int, kept int, component_id string, h int, text_ string, _h int, _lang string"


def odd_table(spark):
    """Extra columns named like every output and inner column, nulls, empties, repeats and a 5 MB text."""
    rng = random.Random(11)
    names = [c.split()[0] for c in CLASHES.split(", ")]
    base = [(i, " ".join(rng.choice("the of and to in is that was for on with".split()) for _ in range(rng.randint(12, 40))), "en") for i in range(60)]
    base += [(100, "the of and, to is; " * 270_000, "en"), (101, None, None), (102, "", ""), (7, base[7][1], "en"), (7, "another text of the same id", "en"), (None, base[3][1], "en"), (103, base[3][1], None)]
    df = spark.createDataFrame([(*r, "s", 1, *[None] * len(names)) for r in base], f"{DDL}, {CLASHES}")
    labels = [(i, i % 2, i % 3 % 2) for i in range(60)] + [(7, 1, 0)] * 50 + [(100, 1, 0), (None, 1, 1), (3, None, None), (999, 0, 1)]
    marks = spark.createDataFrame([(*r, None) for r in labels], "doc_id bigint, quality int, toxic int, text string")
    return df, marks, base


def test_every_operator_takes_odd_tables(spark):
    df, marks, base = odd_table(spark)
    ids = collections.Counter(r[0] for r in base)
    same = lambda out: collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == ids
    bench = spark.createDataFrame([(1, base[3][1]), (None, "the of and to is the of and to is the of and to is")], "item_id bigint, text string")
    assert same(lm.score(df, hot=8)) and same(rules.judge(df, marks)) and same(toxicity.detect(df, marks)) and same(tokens.count_tokens(df))
    assert same(langid.identify(df)) and same(quality.classify(df, marks)) and same(decontaminate.find(df, bench)) and same(neardup.near_duplicates(df))
    assert collections.Counter(packing.pack(df).filter("start = 0").select("doc_id").rdd.map(lambda r: r[0]).collect()) == ids
    for out in (quality.score(df, None, carry=True), langid.predict(df, None, carry=True), decontaminate.find(df, bench, carry=True)):
        back = out.select("row.*")
        assert back.columns == df.columns and back.count() == len(base) and back.select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0


def test_pipeline_carries_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df, marks, _ = odd_table(spark)
    bench = spark.createDataFrame([(1, "no such passage")], "item_id bigint, text string")
    for name, t in (("documents", df), ("labels", marks.drop("text")), ("benchmark", bench)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.saved(stage(spark, at, str(tmp_path)))
        assert at.columns == df.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_null_and_empty_languages_are_one_stratum(spark):
    from pyspark.sql import functions as F

    counts = "doc_id bigint, lang string, n_words bigint, n_lines bigint, word_chars bigint, n_symbols bigint, n_upper bigint, n_dup_lines bigint, n_repeat_words bigint"
    rng = random.Random(10)
    rows = [(i, rng.choice([None, ""]), 100, 5, 1000, 300 if i % 10 == 0 else rng.randint(0, 9), 0, 0, 0) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(6000)], "doc_id bigint, quality int, toxic int")
    measured = spark.createDataFrame(rows, counts)
    assert [c.lang for c in rules.cutoffs(measured, labels).collect()] == [""]
    gone = rules.apply(measured, rules.cutoffs(measured, labels)).filter(~F.col("kept")).join(measured.select("doc_id", "lang"), "doc_id")
    assert {r.lang for r in gone.collect()} == {None, ""}


def test_samples_are_bounded_and_the_same(spark):
    from tidemill.llm.common import bounded_sample

    rows = [(i, i % 3) for i in range(3000)] + [(5, 2)] * 4000
    df = spark.createDataFrame(rows, "doc_id bigint, y int")
    few, counts = bounded_sample(df, "y", 100)
    got = collections.Counter(r.y for r in few.collect())
    assert got == {0: 100, 1: 100, 2: 100} and counts[2] == 5000
    assert few.distinct().count() == 300
    again, _ = bounded_sample(df.repartition(7), "y", 100)
    assert again.exceptAll(few).count() == 0
