import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import components
from rankloom.llm.components import connected_components
from rankloom.llm.minhash_forest import cuts, exact_sets, near_duplicates, prefix_depth, prefix_ids, split_words, text_hash, words_hash


def brute(rows, threshold=0.8, n=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append((tuple(w), {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][0] == sets[b][0] or (both and both >= threshold * len(sets[a][1] | sets[b][1])):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least, size = {}, Counter(find(k) for k in range(len(rows)))
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k))), links[k], size[find(k)]) for k, (i, _) in enumerate(rows))


def sample():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(40, 120))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows += [(len(rows), " ".join(w))] * 1
        rows.append((len(rows), "\t".join(base)))
    big = rng.choices(vocabulary, k=100)
    for k in range(60):
        w = list(big)
        w[k] = "edit"
        rows.append((len(rows), " ".join(w)))
    rows += [(900, "a b"), (901, "a  b"), (902, "a b c"), (903, None), (904, ""), (None, "a b"), (None, "lone text here"), (905, " \n"), (900, "a b"), (906, "word " * 30000), (907, "word " * 29999)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_classes_and_links_against_brute_force(spark, block):
    rows = sample()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, class_id int, h string")
    got = near_duplicates(docs, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.class_size) for r in got) == brute(rows)


@pytest.mark.parametrize("words,block", [(60_000, 256), (1000, 2)])
def test_links_of_long_texts_that_leave_blocks_empty(spark, words, block):
    rows = [(k, " ".join(f"w{n}" if n != 7 * k else f"edit{k}" for n in range(words))) for k in range(12)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.class_size) for r in got) == sorted((str(k), "0", 11, 12) for k in range(12))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_to_the_recall():
    k = prefix_depth(40, 10, 0.8, 0.9999)
    assert 1 - (1 - 0.8**k) ** 40 >= 0.9999 > 1 - (1 - 0.8 ** (k + 1)) ** 40


@pytest.mark.parametrize("hub", [256, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB_LEAST", hub)
    monkeypatch.setattr(components, "HUB_SHARE", 1000 if hub > 3 else 60)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 300 + k) for k in range(50)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    got = dict((r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def sorted_labels(rows):
    return np.array(sorted(rows), np.uint16)


def test_prefixes_are_cut_where_few_share_them():
    # Tree 0: two that share 4 labels; 20 that share 3; tree 1: one alone. The first and last rows pad the chunk.
    rows = [[0, 0, 0, 0, 0], [0, 1, 1, 1, 1], [0, 1, 1, 1, 2]] + [[0, 5, 5, 5, k // 2] for k in range(20)] + [[1, 7, 7, 7, 7], [1, 9, 9, 9, 9]]
    cut, shared = cuts(sorted_labels(rows), 2, 16)
    assert cut.tolist() == [4, 2, 2] + [4] * 20 + [2, 4]
    assert shared.tolist() == [True, True, True] + [True] * 20 + [False, True]
    cut, _ = cuts(sorted_labels(rows), 2, 30)
    assert cut.tolist() == [4] + [2] * 23 + [4]


def test_prefix_names_are_those_of_prefixes():
    labels = sorted_labels([[0, 1, 2, 3], [0, 1, 2, 4], [1, 1, 2, 3]])
    ids = prefix_ids(labels)
    assert (ids[0, :3] == ids[1, :3]).all() and ids[0, 3] != ids[1, 3]
    assert (ids[0] != ids[2]).all()


def test_windows_are_numbered_exactly():
    rng = random.Random(2)
    texts = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(30))] for _ in range(40)]
    for n in (1, 2, 3, 5, 6):
        got = exact_sets(texts, n)
        want = [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in texts]
        for a in range(40):
            assert len(got[a]) == len(want[a])
            for b in range(40):
                assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


@pytest.mark.parametrize("crowd", [4, 1000])
def test_crowded_prefixes_are_shortened_until_the_recall(spark, crowd):
    """200 near copies: crowded in every trie, whose cuts alone would miss pairs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(200):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(rng.choices(base, k=50))) for k in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, block=64).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.class_size) for r in got) == brute(rows)
    assert sorted(r.doc_id for r in got if r.stays) == sorted({r.class_id for r in got})


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, where a forest misses most: 0.8 to 0.83."""
    rng = random.Random(6)
    rows = []
    for g in range(300):
        w = [f"v{rng.randrange(10**7)}" for _ in range(104)]
        other = list(w)
        for at in (20, 60):
            other[at] = f"e{g}"  # ten of 100 windows differ: 90 / 110 = 0.818
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(other))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_links == 1 and r.class_id == r.doc_id - r.doc_id % 2 for r in got) >= 598


def test_hash_of_words_in_spark(spark):
    texts = [None, "", " \n", "a  b\tc ", "é x\x0by", "a b c"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_hash(F.col("t")).alias("h")).collect()]
    assert got == [words_hash(split_words(t)) for t in texts]
