"""Learned operators: gradients, held-out accuracy on planted classes, odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ahocorasick")

from tidemill.llm import attention, langid, lm, quality, rules, toxicity  # noqa: E402

WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this".split(), "de": "der die und das ist nicht ein zu den mit sich auf für im dem als über würde".split(), "fr": "le la les et des est que une pour dans qui pas sur plus par été où à".split(), "es": "el los que una por con para como más pero sus este ya muy años también señor".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice([".", ","]) if rng.random() < 0.1 else "") for _ in range(n))


def odd(rows):
    """Odd rows of a documents table: null and empty texts, a repeated row, a null id."""
    return [*rows, (9001, None, "en", "s", 0), (9002, "", "de", "s", 0), (9003, "12 34 !!", None, "s", 0), (9004, "the of", None, None, None), (9004, "the of", None, None, None), (None, "the of and", "en", "s", 1)]


DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def in_training(i, mod=4):
    return zlib.crc32(str(i).encode()) % mod != 2


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    flat = attention.initial()
    for name in ("g", "m"):
        p = attention.unpack(flat)[name]
        p[:] = rng.normal(0, 0.1, p.shape)
    c = attention.CLASSES
    tables = rng.normal(size=(c, attention.GROUPS)).astype(np.float32), rng.normal(size=(c, attention.GROUPS, attention.MEMBERS)).astype(np.float32)
    x, y = rng.integers(0, c, (2, 3, attention.LENGTH))
    mask = rng.random(x.shape) < 0.7
    loss = lambda f: -attention.log_probs(attention.unpack(f), tables, x, y, mask).astype(float).mean()
    grad = attention.gradient(flat, tables, x, y, mask)
    for name in attention.SHAPES:
        g = attention.unpack(grad)[name].ravel()
        k = int(np.abs(g).argmax())
        up, down = flat.copy(), flat.copy()
        attention.unpack(up)[name].ravel()[k] += 1e-2
        attention.unpack(down)[name].ravel()[k] -= 1e-2
        assert g[k] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=1e-4)


def test_attention_does_not_look_ahead_and_sums_to_one():
    p = attention.unpack(attention.initial())
    c = attention.CLASSES
    tables = attention.tables_of(np.random.default_rng(1).integers(0, 3, (c, c)))
    x = np.random.default_rng(2).integers(0, c, (1, attention.LENGTH))
    later = x.copy()
    later[0, 20:] = 5
    h, h2 = (attention._hidden(p, attention.projected(p), v)[-1] for v in (x, later))
    assert np.allclose(h[:20], h2[:20], atol=1e-5)
    mask = np.zeros(x.shape, bool)
    mask[0, 7] = True
    total = sum(math.exp(attention.log_probs(p, tables, x, np.full(x.shape, t), mask)[0]) for t in range(c))
    assert total == pytest.approx(1, abs=1e-3)


def test_windows_mask_every_token_once():
    for sizes in ([1], [0, 5, 31, 32, 33, 200], [58, 59]):
        off = np.concatenate([[0], np.cumsum(sizes)])
        s = np.arange(off[-1])
        x, y, mask, text = attention.windows(s, off, 999)
        assert sorted(y[mask].tolist()) == s.tolist()
        first = set(off[:-1].tolist())
        assert all(b == (999 if a in first else a - 1) for a, b in zip(y[mask].tolist(), x[mask].tolist()))


def test_windows_overlap_by_enough_context():
    s = np.arange(200)
    x, y, mask, _ = attention.windows(s, np.array([0, 200]), 999)
    assert attention.LENGTH >= 32
    for seen, m in zip(x[1:], mask[1:]):
        assert m.argmax() >= 6 and (np.diff(seen[: m.argmax() + 1]) == 1).all()


def test_lm_scores(spark):
    rng = random.Random(5)
    rows = odd([(i, prose(rng, "en", rng.randint(1, 60)), "en", "s", 1) for i in range(300)])
    df = spark.createDataFrame(rows, DDL)
    got = lm.score(df, least_steps=20, hot=8).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    train = [r for r in rows if r[0] is not None and in_training(r[0], 7)]
    counts = collections.Counter(w for r in train for w in words(r[1]))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    want = sorted((r[0] is not None and not in_training(r[0], 7), len(words(r[1])) + 1, sum(counts[w] > 0 for w in words(r[1])) + 1, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(r[1])) + math.log10((len(train) + 1) / (total + distinct + 1)), 6)) for r in rows)
    assert sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)
    assert lm.score(df.limit(0), least_steps=1).collect() == []


def test_lm_learns_from_every_training_document_once(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") for _ in range(4))) for i in range(9000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    rounds, classes = [], []
    train_round, vocabulary = lm._train_round, lm.Vocabulary.__init__
    monkeypatch.setattr(lm, "_train_round", lambda chosen, *rest: (rounds.append(chosen.count()), train_round(chosen, *rest))[1])
    monkeypatch.setattr(lm.Vocabulary, "__init__", lambda self, ids, size: (classes.append(ids.tolist()), vocabulary(self, ids, size))[1])
    assert lm.score(df, hot=8).count() == len(docs)
    train = [t for i, t in docs if in_training(i, 7)]
    assert sum(rounds) == len(train) and min(rounds) > len(train) / 3
    counts = collections.Counter()
    bpe = lm.load_bpe("byte_bpe_50k.json")
    ids, _ = bpe.encode_column(lm.normal_texts(pa.array(train, pa.large_string())))
    counts.update(ids.tolist())
    assert classes == [[i for i, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.KEPT_IDS]]]


def test_language_identification(spark):
    rng = random.Random(6)
    rows = odd([(i, prose(rng, lang := rng.choice(list(WORDS)), rng.randint(8, 60)), lang, "s", 1) for i in range(400)])
    df = spark.createDataFrame(rows, DDL)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows[:400] if not in_training(r[0])]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) > 0.95 * len(held)
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and len(langid.identify(df).collect()) == len(rows)
    one = langid.identify(df.filter("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}
    assert {r.lang_pred for r in langid.identify(df.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def labelled(rng, n, bad):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = prose(rng, "en", rng.randint(20, 80))
        rows.append((i, t if good else bad(t, rng), "en", "s", 1))
        labels.append((i, int(good), int(not good)))
    return rows, labels


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = labelled(rng, 500, lambda t, r: r.choice([t.replace(" ", " | "), t.upper() + "!!", (t[:20] + ". ") * 20]))
    df, marks = spark.createDataFrame(odd(rows), DDL), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    held = [x for x in labels if not in_training(x[0])]
    assert sum(got[i].predicted == q for i, q, _ in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert {r.score for r in quality.classify(df, marks.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), marks).collect() == []


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel.fit(x[:3000], y[:3000], np.ones(3000), n_pairs=1)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_toxicity(spark):
    rng = random.Random(8)
    disguise = lambda w, r: r.choice([w, w.upper(), w.replace("o", "0"), w.replace("o", "о"), w.replace("i", "1")])
    bad = lambda t, r: " ".join(x if r.random() > 0.1 else disguise(r.choice(["moron", "idiot", "loser"]), r) for x in (t + " moron").split(" "))
    rows, labels = labelled(rng, 900, bad)
    df, marks = spark.createDataFrame(odd(rows), DDL), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(df, marks).collect()}
    held = [x for x in labels if not in_training(x[0])]
    assert sum(got[i].predicted == t for i, _, t in held) > 0.97 * len(held)
    assert got[9001].predicted == got[9002].predicted == 0
    assert {r.score for r in toxicity.detect(df, marks.limit(0)).collect()} == {0.0}
    assert toxicity.detect(df.limit(0), marks).collect() == []


def test_folding_and_exceptions():
    assert toxicity.folded("M0r0n, IDІOT 1d1ot! x 2024").split() == ["moron", "idiot", "idiot", "x"]
    lex = toxicity.Lexicon({" clown ": 2.0, " moro": 3.0}, [" clown fish "], np.zeros(4))
    assert lex.measure("a Clown fish")[:2] == (0, 0)
    assert lex.measure("clown, moronic")[:2] == (5.0, 2)


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.defaultdict(list)
    for i in range(len(w) - 4):
        wins[tuple(w[i : i + 5])].append(i)
    hit = {i + j for at in wins.values() if len(at) > 1 for i in at for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark):
    rng = random.Random(9)
    texts = ["", "a b c d e a b c d e", "x\nx\n \n\ny x", "#|<日本 é"] + ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "a b c d e f\n"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(odd(rows), DDL)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for r in rules.judge(df, labels).collect():
        t = dict((x[0], x[1] or "") for x in odd(rows))[r.doc_id]
        want = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.kept == (not r.base_failed) and r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert rules.judge(df.limit(0), labels).collect() == []


def test_cutoffs_are_safe_and_useful(spark):
    rng = random.Random(10)
    ddl = "doc_id bigint, lang string, n_words bigint, n_lines bigint, word_chars bigint, n_symbols bigint, n_upper bigint, n_dup_lines bigint, n_repeat_words bigint"
    rows = [(i, "en", 100, 5, 1000, 300 if i % 10 == 0 else rng.randint(0, 9), 0, 0, 0) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(6000)], "doc_id bigint, quality int, toxic int")
    cuts = rules.cutoffs(spark.createDataFrame(rows, ddl), labels).collect()
    assert [(c.lang, c.cut_symbols, c.cut_upper) for c in cuts] == [("en", 200, rules.NO_CUTOFF)]
    few = rules.cutoffs(spark.createDataFrame(rows[:500], ddl), labels).collect()
    assert few == []


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (40, 9000, 0.005)):
        got = spark.range(1).select(F.expr(rules.binomial_tail(f"{k}L", f"{n}L", p)).alias("t")).first().t
        assert got == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-6)
