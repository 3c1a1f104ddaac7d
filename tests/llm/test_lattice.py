import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from rankloom.llm import lattice
from rankloom.llm.common import fold
from rankloom.llm.lattice import MARK, PieceLattice, score_documents, words
from rankloom.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def small():
    pieces = {MARK: 3.0, MARK + b"a": 5.0, b"a": 2.0, b"ab": 4.0, b"b": 1.0, b"bb": 2.0, "é".encode(): 1.5}
    return PieceLattice.of_counts(pieces, np.full(256, 0.1), 2.0)


def brute(m, w):
    """Sum over all segmentations, written out."""
    w, total = MARK + w, 0.0
    for cuts in product((False, True), repeat=len(w) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(w[at:i])
                at = i
        parts.append(w[at:])
        p = 1.0
        for x in parts:
            p *= (math.exp(m.weights[x]) if x in m.weights else 0) + (math.exp(m.single[x[0]]) if len(x) == 1 else 0)
        total += p
    return total


@pytest.mark.parametrize("w", [b"", b"a", b"ab", b"abb", b"abab", "éa".encode(), b"zab"])
def test_marginal_is_the_sum_over_segmentations(w):
    m = small()
    assert math.isclose(math.exp(m.marginal(w)), brute(m, w), rel_tol=1e-9)


def test_expected_uses_and_total_weight():
    m = small()
    assert math.isclose(sum(map(math.exp, m.weights.values())) + sum(map(math.exp, m.single)) + math.exp(m.end), 1)
    found, single = {}, np.zeros(256)
    m.expected(b"abab", 3.0, found, single)
    assert math.isclose(sum(len(p) * n for p, n in found.items()) + single.sum(), 3 * len(MARK + b"abab"), rel_tol=1e-9)


@pytest.mark.parametrize("w", [b"", b"ab", b"abbab", "zéa".encode(), b"abab" * 4])
def test_both_ways_of_expected_uses_agree(w):
    m, by = small(), [({}, [0.0] * 256), ({}, [0.0] * 256)]
    m.expected(w, 2.5, *by[0])
    m._expected_long(MARK + w, 2.5, *by[1])
    assert by[0][0].keys() == by[1][0].keys()
    assert all(math.isclose(by[0][0][k], by[1][0][k], rel_tol=1e-9) for k in by[0][0])
    assert np.allclose(by[0][1], by[1][1])


@pytest.mark.parametrize("frequent", [2, 150_000])
def test_scores_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    texts = ["The cat sat", "the\x0bCAT  ran É", None, "", "dog x y", "cat " * 50, "zq" * 3000, "the end"]
    rows = [(i, t, 0) for i, t in enumerate(texts * 3)] + [(1, texts[1], 0), (None, "cat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_known int")
    got = score_documents(docs, fold("doc_id", 7) != 2, PATH).collect()
    train = [t for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in words(t))
    c["end"] = 0
    n, v = sum(c.values()) - c["end"] + len(train), len([w for w in c if c[w]]) + 1
    want = []
    for i, t, _ in rows:
        ws = words(t)
        known = sum(c[w] > 0 for w in ws) + 1
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((str(i), len(ws) + 1, known, n, round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(0 > r.score and math.isfinite(r.score) and math.isfinite(r.mixed_score) for r in got)


def segmentations(w):
    """Every way to cut a marked word, as lists of parts."""
    w = MARK + w
    for cuts_ in product((False, True), repeat=len(w) - 1):
        at = [0, *(i for i, cut in enumerate(cuts_, 1) if cut), len(w)]
        yield [w[a:b] for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("frequent", [1, 150_000])
def test_lattice_scores_against_brute_force(spark, monkeypatch, frequent):
    """The learned weights and the scores, with every segmentation written out."""
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    texts = ["the cat sat", "a cat ran É", None, "the dog", "zq the", "cat cat", "sun", "tin can"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(docs, fold("doc_id", 7) != 2, PATH).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    start = PieceLattice.of_model(PATH)
    uses, single = dict.fromkeys(start.weights, 0.01), np.full(256, 0.1)
    for w, n in Counter(w for t in train for w in words(t)).items():
        ways = []
        for parts in segmentations(w):
            # A one-byte part is a piece or the byte itself: two ways.
            options = [[(x, start.weights.get(x))] + ([(x[0], start.single[x[0]])] if len(x) == 1 else []) for x in parts]
            ways += [(way, math.exp(sum(p for _, p in way))) for way in product(*options) if all(p is not None for _, p in way)]
        whole = sum(p for _, p in ways)
        for way, p in ways:
            for x, _ in way:
                if isinstance(x, int):
                    single[x] += n * p / whole
                else:
                    uses[x] += n * p / whole
    mass = sum(uses.values()) + single.sum() + len(train)
    for i, t in enumerate(texts):
        want = math.log10(len(train) / mass)
        for w in words(t):
            p = 0.0
            for parts in segmentations(w):
                p += math.prod(uses.get(x, 0) / mass + (single[x[0]] / mass if len(x) == 1 else 0) for x in parts)
            want += math.log10(p)
        assert math.isclose(got[i].score, want, rel_tol=1e-6), (i, t)
    # The mixture: the same marginal with the word's own frequency.
    c = Counter(w for t in train for w in words(t))
    total, once = sum(c.values()) + len(train), sum(n == 1 for n in c.values())
    new = min(0.5, max(0.001, once / total))
    alone = got[6].score - math.log10(len(train) / mass)
    want = math.log10((1 - new) * c[b"sun"] / total + new * 10**alone) + math.log10((1 - new) * len(train) / total + new * len(train) / mass)
    assert math.isclose(got[6].mixed_score, want, rel_tol=1e-6)


def test_frequent_words_are_those_above_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 5)
    rows = spark.createDataFrame([(f"w{k}".encode(), n) for k, n in enumerate([0, 0, 1, 1, 1, 2, 2, 40, 41, 900])], "word binary, c long")
    assert sorted(lattice._frequent(rows)["c"].to_pylist()) == [2, 2, 40, 41, 900]
    monkeypatch.setattr(lattice, "FREQUENT", 0)
    assert lattice._frequent(rows).num_rows == 0


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = score_documents(docs, F.lit(False), PATH).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert got[0].score < got[1].score < 0
    assert score_documents(docs.limit(0), F.lit(True), PATH).count() == 0
