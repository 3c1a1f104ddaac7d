import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import substring
from rankloom.llm.substring import Words, without_repeated


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, k):
    """Sorted (doc_id, n_words, n_removed, kept); rows of unknown id come last and are ordered by nothing here."""
    least = {}
    for i, t in rows:
        w = words(t)
        for at in range(len(w) - k + 1):
            key = tuple(w[at : at + k])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            if least[tuple(w[at : at + k])] < (float("inf") if i is None else i):
                gone[at : at + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(map(str, out))


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    made = lambda n: [rng.choice(["", "é", "ü "]) + "w" * rng.randrange(4) + str(rng.randrange(vocabulary)) for _ in range(n)]
    line, passages = made(6), [made(rng.randrange(13, 60)) for _ in range(5)]
    rows = []
    for i in range(160):
        w = made(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice([line, line * 4, *passages])
        rows.append((i * 3 % 160, rng.choice([" ", "\n", " \t", "\x0b\x0c"]).join(w) + rng.choice(["", " ", "\r\n"])))
    rows += [(500 + i, rows[3][1]) for i in range(70)]  # a large group of copies
    rows += [(600, " ".join(line * 300)), (601, " ".join(line * 300 + made(20)))]  # one line over and over, within documents
    rows += [(700, None), (701, ""), (702, " \t\n"), (703, "x" * 3000), (704, " ".join(["same"] * 13)), (705, " ".join(["same"] * 40)), (None, None)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1])]  # a repeated row, an id with two texts
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, " ".join(made(30)))]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, a int").repartition(6)
    return without_repeated(df, **more)


def told(df):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in df.collect())


@pytest.mark.parametrize("seed, k, chunk", [(0, 13, 8 << 20), (1, 13, 3000), (2, 3, 1), (3, 13, 1)])
def test_against_brute_force(spark, monkeypatch, seed, k, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rows = corpus(seed, 400 if k > 3 else 60)
    got = run(spark, rows, k=k, bucket_bytes=2000)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert told(got) == brute(rows, k)


def test_split_minimisers_and_equal_hashes(spark, monkeypatch):
    """Hot minimisers are split, and windows whose hashes agree by chance are told apart by their bytes."""
    monkeypatch.setattr(substring, "SAMPLED", 1)
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string").select(F.col("text").cast("binary").alias("text"), F.lit(False).alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("a"), F.xxhash64("text").alias("b"))
    hot = substring.hot_minimisers(docs, 13, 50)
    assert hot
    assert told(run(spark, corpus(4), bucket_bytes=2000)) == brute(corpus(4), 13)


def test_equal_hashes_of_different_windows(monkeypatch):
    mixed = substring._mixed
    monkeypatch.setattr(substring, "_mixed", lambda h: mixed(h) % np.uint64(7))
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))).encode() for _ in range(30)]
    rank = np.array([rng.randrange(20) for _ in texts])
    w = Words(texts, 3)
    lead = w.leaders(rank)
    first = {}
    for i in sorted(range(len(w.windows)), key=lambda i: (rank[w.text[w.windows[i]]], i)):
        assert lead[i] == first.setdefault(w.packed(w.windows[i], 1), i)


def test_super_kmers_hold_every_window_once():
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(9)) for _ in range(rng.randrange(50))).encode() for _ in range(40)]
    w = Words(texts, 13)
    sent = np.array(sorted(rng.sample(range(len(w.windows)), len(w.windows) // 2)))
    for hot in (np.zeros(0, np.uint64), w.minimisers()[sent][:5]):
        bucket, word, count = substring._super_kmers(w, sent, 11, hot)
        held = [at + i for at, n in zip(word.tolist(), count.tolist(), strict=True) for i in range(n)]
        assert held == w.windows[sent].tolist()
        # Equal windows meet in one bucket.
        of = {}
        for at, n, b in zip(word.tolist(), count.tolist(), bucket.tolist(), strict=True):
            for i in range(n):
                assert of.setdefault(w.packed(at + i, 1), b) == b


def test_unknown_ids_are_ordered_by_text(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    got = {(r.kept, r.n_removed) for r in run(spark, [(None, f"{shared} a"), (None, f"{shared} b"), (None, f"{shared} a")]).collect()}
    assert got in ({(f"{shared} a", 0), ("b", 20)}, {(f"{shared} b", 0), ("a", 20)})
    assert {r.kept for r in run(spark, [(None, f"{shared} a"), (9, shared)]).collect()} == {shared, "a"}


def test_empty_and_carried(spark):
    assert run(spark, []).count() == 0
    got = run(spark, [(1, "a b")], carry={"own": F.col("a") + 1, "text": F.col("text")})
    assert got.columns == ["own", "text", "n_words", "n_removed", "kept"] and tuple(got.first()) == (2, "a b", 2, 0, "a b")
