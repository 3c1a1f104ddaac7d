import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import language_id, toxicity
from rankloom.llm.common import fold

EN, DE = "the quick brown fox and the lazy dog were there with them ", "der schnelle braune fuchs und die faulen hunde waren nicht dort "


def test_language_id(spark):
    rows = [(i, (EN if i % 3 else DE) * (1 + i % 4), "en" if i % 3 else "de", 0.5) for i in range(200)]
    rows += [(300, None, "en", 0.0), (301, "12 !?", "de", 0.0), (302, "", None, 0.0), (303, DE, None, 0.0), (None, EN, "en", 0.0), (304, EN * 20000, "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    held = fold("doc_id", 4) == 2
    model = language_id.train(docs.where(~held))
    got = language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held}).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, lang, _ in rows:
        want = "und" if not text or not any(c.isalpha() for c in text) else lang or "de"
        assert by[i].lang_pred == want, i
        assert 0 <= by[i].score <= 1
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 40):
        c = language_id.codewords(k)
        gaps = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= (1 if k < 3 else 2)


def test_decoding_against_a_plain_version():
    rng = np.random.default_rng(3)
    m = language_id.CodedClassifiers(list("abcd"), rng.integers(1, 50, (4, 64)).astype(float))
    counts = rng.integers(0, 4, (30, 64)).astype(float)
    best, score, ambiguous = m.decode(counts, gap=0.7)
    for row, k, s, flag in zip(counts, best, score, ambiguous, strict=True):
        losses = []
        for code in m.codes:
            loss = 0.0
            for bit, weights in zip(code, m.weights.T, strict=True):
                margin = sum(c * w for c, w in zip(row, weights.astype(float), strict=True)) / row.sum() * min(row.sum(), language_id.EFFECTIVE_GRAMS)
                loss += math.log(1 + math.exp(-bit * margin))
            losses.append(loss)
        assert losses[k] == min(losses)
        assert math.isclose(s, math.exp(-losses[k]) / sum(math.exp(-x) for x in losses), rel_tol=1e-4)
        first, second = sorted(losses)[:2]
        assert flag == (second - first < 0.7)


def test_decoding_corrects_a_wrong_bit():
    m = language_id.CodedClassifiers(list("abcde"), np.ones((5, 64)))
    for k in range(5):
        for wrong in range(m.codes.shape[1]):
            margins = m.codes[k] * 2.0
            margins[wrong] *= -1
            m.weights = np.diag(margins).astype(np.float32)
            best, *_ = m.decode(np.full((1, len(margins)), language_id.EFFECTIVE_GRAMS / len(margins) * 1.0) * len(margins))
            assert best[0] == k


def test_bits_are_fitted_to_their_own_loss():
    """Fitting lowers the loss of every bit below that of the bare log odds, and its slopes are those of the loss."""
    rng = np.random.default_rng(4)
    profiles = rng.dirichlet(np.ones(40) * 0.5, 4)
    lang = rng.integers(0, 4, 300)
    counts = np.stack([rng.multinomial(30, 0.6 * profiles[k] + 0.4 * profiles[(k + 1) % 4]) for k in lang]).astype(float)
    m = language_id.CodedClassifiers(list("abcd"), np.stack([counts[lang == k].sum(0) for k in range(4)]) * rng.choice([0.2, 1, 3], (4, 40)))
    weight = 1 / np.bincount(lang)[lang] / 4

    def losses():
        return (weight[:, None] * np.log1p(np.exp(-m.codes[lang] * m.margins(counts)))).sum(0)

    before = losses()
    m.fit(counts, lang)
    assert (losses() < before).all() and losses().mean() < 0.7 * before.mean()


def test_weights_of_bits_change_the_winner():
    """A bit that is always wrong for a language counts little in that language's distance."""
    m = language_id.CodedClassifiers(["a", "b", "c"], np.ones((3, 64)))
    bits = m.codes.shape[1]
    margins = np.where(np.arange(bits) == 0, 9.0 * -m.codes[0, 0], 0.5 * m.codes[0])  # the first bit speaks loudly against a
    m.weights = np.diag(margins).astype(np.float32)
    row = np.full((1, bits), language_id.EFFECTIVE_GRAMS / bits) * bits
    plain, *_ = m.decode(row)
    assert plain[0] != 0
    hits = np.full((3, bits), 98.0)
    hits[0, 0] = 0
    m.weigh(hits, np.full(3, 98.0))
    right = np.where((np.arange(3)[:, None] == 0) & (np.arange(bits) == 0), 1 / 100, 99 / 100)
    assert np.allclose(m.importance, right / right.sum(1, keepdims=True))
    won, *_ = m.decode(row)
    plain_losses = [(m.importance[k] * np.log1p(np.exp(-m.codes[k] * m.margins(row)[0]))).sum() for k in range(3)]
    assert won[0] == 0 == int(np.argmin(plain_losses))


def test_hits_and_sample_against_a_plain_version(spark):
    rows = [((EN if i % 3 else DE)[i % 20 :] + f" x{i}", "en" if i % 3 else "de") for i in range(120)] + [(EN, "en")] * 50 + [(None, "en"), ("12", "de"), ("ohne", None), (DE, "en")]
    docs = spark.createDataFrame(rows, "t string, l string").select("l", "t").where("t IS NOT NULL AND l IS NOT NULL")
    model = language_id.train(docs, "l", "t", features=512, sample_rows=40)
    hits, totals = language_id._hits(docs, model, 512)
    want, n = np.zeros_like(hits), np.zeros(2)
    for t, lang in rows:
        if t and lang and language_id.gram_counts(t, 512).any():
            k = model.languages.index(lang)
            want[k] += (model.margins(language_id.gram_counts(t, 512)[None].astype(np.float32)) * model.codes[k] > 0)[0]
            n[k] += 1
    assert (hits == want).all() and (totals == n).all()
    assert np.allclose(model.importance, ((want + 1) / (n[:, None] + 2)) / ((want + 1) / (n[:, None] + 2)).sum(1, keepdims=True))
    counts, lang = language_id._sampled(docs, model.languages, n, 512, 40)
    assert len(counts) == len(lang) and 10 <= len(counts) <= 80 and len(np.unique(counts, axis=0)) <= len(counts)


def test_equally_near_codewords_are_ambiguous():
    m = language_id.CodedClassifiers(["a", "b"], np.ones((2, 64)))
    best, score, ambiguous = m.decode(np.ones((1, 64)))
    assert (best[0], round(score[0], 6), bool(ambiguous[0])) == (0, 0.5, True)


def test_counts_and_weights_against_a_plain_version(spark):
    rows = [(EN, "en"), (DE + " Straße!", "de"), (EN[:20], "en"), ("日本 x9", "ja"), (None, "en"), ("12", "de"), ("ohne", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), features=512)
    assert model.languages == ["de", "en", "ja"]
    total = {lang: np.zeros(512) for lang in model.languages}

    def bucket(x, times):
        return ((x * times) % 2**32) >> (32 - 9)

    for text, lang in rows:
        if text is None or lang is None:
            continue
        codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        for at in range(len(codes) - 1):
            two = (codes[at] * 0x9E3779B1 + codes[at + 1]) % 2**32
            if codes[at] or codes[at + 1]:
                total[lang][bucket(two, 0xC2B2AE35)] += 1
            if at + 2 < len(codes) and codes[at + 1]:
                total[lang][bucket((two * 0x85EBCA6B + codes[at + 2]) % 2**32, 0x27D4EB2F)] += 1
    share = {k: (v + 0.1) / (v.sum() + 51.2) for k, v in total.items()}
    for bit in range(model.codes.shape[1]):
        yes = [share[lang] for lang, code in zip(model.languages, model.codes, strict=True) if code[bit] > 0]
        no = [share[lang] for lang, code in zip(model.languages, model.codes, strict=True) if code[bit] < 0]
        assert np.allclose(model.weights[:, bit], np.log(sum(yes) / len(yes)) - np.log(sum(no) / len(no)), atol=1e-4)
    docs = spark.createDataFrame([(1, EN, 9.0), (2, DE, 9.0)], "doc_id long, text string, score double")
    got = language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "score": F.col("score")})
    assert got.columns == ["doc_id", "lang_pred", "score", "ambiguous"]
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["en", "de"]
    assert language_id.predict(docs.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_risk_and_its_slope_in_both_branches(shift):
    """Against losses written out and differences; shift 4 makes the second part negative."""
    rng = np.random.default_rng(2)
    gp, gu, prior = rng.normal(size=7) + shift, rng.normal(size=11) - shift, 0.3
    loss = lambda z: math.log(1 + math.exp(-z))
    first = prior * sum(loss(g) for g in gp) / 7
    second = sum(loss(-g) for g in gu) / 11 - prior * sum(loss(-g) for g in gp) / 7
    assert np.allclose(toxicity.risk_parts(gp, gu, prior), (first, second))
    assert (second < 0) == (shift > 0)

    def descended(p, u):
        a, b = toxicity.risk_parts(p, u, prior)
        return -b if shift else a + b

    by_p, by_u = toxicity.score_slopes(gp, gu, prior)
    for k in range(7):
        e = np.eye(7)[k] * 1e-5
        assert math.isclose(by_p[k], (descended(gp + e, gu) - descended(gp - e, gu)) / 2e-5, abs_tol=1e-6)
    for k in range(11):
        e = np.eye(11)[k] * 1e-5
        assert math.isclose(by_u[k], (descended(gp, gu + e) - descended(gp, gu - e)) / 2e-5, abs_tol=1e-6)


def test_fit_lowers_the_risk_below_that_of_the_prior(spark):
    """The trained scores have a smaller non-negative risk than any constant score."""
    rng = np.random.default_rng(7)
    words = [chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(200)]
    bad = [rng.choice(words, 30).tolist() + ["vile"] for _ in range(40)]
    some = [rng.choice(words, 30).tolist() + (["vile"] if k % 10 == 0 else []) for k in range(400)]
    names = toxicity.named([Counter(t) for t in bad])
    valued = lambda texts: toxicity.matrix([toxicity.Features(names).values(Counter(t)) for t in texts])
    m = toxicity.NonNegativePU(names, valued(bad), valued(some), 0.1)
    logit = lambda t: math.log(m.score(" ".join(t)) / (1 - m.score(" ".join(t))))
    risk = lambda gp, gu: (lambda a, b: a + max(0.0, b))(*toxicity.risk_parts(np.array(gp), np.array(gu), 0.1))
    constant = min(risk([g] * 40, [g] * 400) for g in np.linspace(-6, 6, 121))
    assert risk([logit(t) for t in bad], [logit(t) for t in some]) < 0.5 * constant


def test_names_and_values_of_a_sample_against_a_plain_version(spark):
    """What tasks work out equals the definitions, text by text, and so do means and the choice of features."""
    rng = random.Random(6)
    vocabulary = ["vile", "vileness", "calm", "calmly", "über", "a", "ab"]
    texts = {str(i): " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) or None for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "i string, t string").repartition(5)
    counted = [toxicity.word_counts(t) for t in texts.values()]
    held = {}
    for counts in counted:
        for x in {w + "$" for w in counts} | {w[:n] for w in counts for n in range(3, min(len(w), 8) + 1)}:
            held[x] = held.get(x, 0) + 1
    names = toxicity._names(df)
    assert names == sorted(x for x, n in held.items() if n >= 3) == toxicity.named(counted)
    rows, at, x, n = toxicity._values(df, names)
    got = {}
    for r, k, v in zip(rows.tolist(), at.tolist(), x.tolist(), strict=True):
        got[sorted(texts)[r], names[k]] = v
    want = {}
    for i, t in texts.items():
        counts = toxicity.word_counts(t)
        for name in names:
            uses = sum(c for w, c in counts.items() if name == w + "$" or (not name.endswith("$") and w.startswith(name) and len(name) <= min(len(w), 8)))
            if uses:
                want[i, name] = 1.0 if name.endswith("$") else math.log1p(50 * uses / (sum(counts.values()) + 30))
    assert n == 60 and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    mean, square = toxicity._means((rows, at, x, n), len(names))
    told = toxicity._told(df, names)
    assert told[0] == 60 and np.allclose(told[1], mean, atol=1e-8) and np.allclose(told[2], square, atol=1e-8)
    for k, name in enumerate(names):
        own = [v for (_, y), v in want.items() if y == name]
        assert math.isclose(mean[k], sum(own) / 60, abs_tol=1e-12) and math.isclose(square[k], sum(v * v for v in own) / 60, abs_tol=1e-12)


def test_long_tied_and_repeated_texts(spark):
    rng = np.random.default_rng(0)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(filler, 40).tolist() + (["rotten"] if i % 8 == 0 else []))) for i in range(600)]
    rows += [(9000, "calm " * 300_000 + "rotten"), (9001, "rotten"), (9002, "rotten"), (9002, "rotten"), (9003, "calm " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "score": F.lit(7)}).where("doc_id >= 9000").collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 5 and by[9001] == by[9002]
    assert by[9000] > by[9003]  # the last word of a very long text counts


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        text = rng.choice(words, 40).tolist() + (["Rotten", "vile!"][: 1 + i % 2] if bad else [])
        rows.append((i, " ".join(text), 1))
        if i % 3 == 0:
            labels.append((i, int(bad)))
    rows += [(2000, None, 1), (2001, "", 1), (None, "rotten", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    table = spark.createDataFrame([*labels, *labels[:5], (None, 1), (77, None)], "doc_id long, toxic int")
    held = fold("doc_id", 4) == 2
    model = toxicity.train(docs, table, ~held)
    got = toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held}).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in tested)
    assert {r.score for r in toxicity.score(docs, None, {"doc_id": F.col("doc_id")}).collect()} == {0.0}
    assert toxicity.train(docs, table.limit(0), ~held) is None
    assert toxicity.score(docs.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


def test_toxicity_by_beginnings_of_words(spark):
    rng = np.random.default_rng(1)
    ends = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(600)]
    rows, labels = [], []
    for i in range(2000):
        bad = i % 8 == 0
        # Toxic texts hold five of 600 words of one beginning, every third other text holds one of them.
        marked = ["grolb" + x for x in rng.choice(ends, 5 if bad else int(i % 3 == 0), replace=False)]
        rows.append((i, " ".join(["w" + x for x in rng.choice(ends, 120)] + marked)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = fold("doc_id", 4) == 2
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held)
    got = toxicity.score(docs, model, {"doc_id": F.col("doc_id")}, "text").where(held).collect()
    caught = [r.score >= 0.3 for r in got if r.doc_id % 8 == 0]
    assert np.mean(caught) >= 0.95
    assert np.mean([r.score >= 0.3 for r in got if r.doc_id % 8]) <= 0.02
