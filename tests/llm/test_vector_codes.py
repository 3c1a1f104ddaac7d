import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.vector_codes import Tree, books_digest, code_text, vector_codes


@pytest.mark.parametrize("spread", [2, 40, 100_000])
def test_tree_finds_the_smallest_index_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (256, 5))
    entries[100:140] = entries[7]  # more equal entries than a leaf holds
    x = rng.integers(-spread, spread, (3000, 5))
    x[:50] = entries[120]
    at, d = Tree(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()


def brute(rows, parts, entries, rounds):
    """{row: (code, error)} and the codebooks, of (id, integers) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v in rows])
    edge = [x.shape[1] * p // parts for p in range(parts + 1)]
    cut = [x[:, a:b] for a, b in zip(edge, edge[1:], strict=False)]
    books = [c[:entries].copy() for c in cut]
    near = lambda c, b: ((c[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for c, b in zip(cut, books, strict=True):
            at = near(c, b).argmin(1)
            for e in set(at.tolist()):
                own = c[at == e]
                b[e] = [int(s) // len(own) for s in own.sum(0)]
    d = [near(c, b) for c, b in zip(cut, books, strict=True)]
    return [(r[0], [int(m[i].argmin()) for m in d], int(sum(m[i].min() for m in d))) for i, r in enumerate(rows)], books


@pytest.mark.parametrize("width, entries", [(8, 16), (10, 64)])
def test_against_brute_force(spark, width, entries):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(400, width)) * 3) / 64
    x[200:330] = x[5]  # a very common vector
    rows = [(i, x[i].tolist(), i % 3 or None) for i in range(400)] + [(7, x[9].tolist(), 1), (None, x[8].tolist(), 1)]
    bad = [(900, None, 1), (901, [float("nan")] * width, 1), (902, [None] * width, 1), (903, [float("inf")] * width, 1)]
    odd = [(904, [1.0] * (width + 1), 1), (905, [1e30] * width, None)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows + bad + odd], "vec_id long, embedding array<double>, label int, code string, v int").repartition(5)
    got, books = vector_codes(df, carry={"label": F.col("label")}, entries=entries)
    want, made = brute([(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v, _ in rows], 4, entries, 4)
    mine = got.collect()
    assert got.columns == ["vec_id", "label", "code", "error"]
    assert sorted(str((r.vec_id, r.code, r.error)) for r in mine if r.code is not None) == sorted(map(str, want))
    assert sorted(r.vec_id for r in mine if r.code is None and r.error is None) == [904, 905]
    assert all((a == b).all() for a, b in zip(books, made, strict=True))
    assert books_digest(books) == hashlib.sha256(",".join(str(v) for b in made for v in b.ravel()).encode()).hexdigest()


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(2, [0.5, 0.0, -0.0005, 1.0]), (1, [0.5, 0.25, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got, books = vector_codes(few)
    assert {r.vec_id: (r.c, r.error) for r in got.withColumn("c", code_text(F.col("code"))).collect()} == {1: ("00000000", 0), 2: ("00010101", 0)}
    assert [b.ravel().tolist() for b in books] == [[512, 512], [256, 0], [0, -1], [0, 1024]]
    got, books = vector_codes(few.where("vec_id > 5"))
    assert got.count() == 0 and all(len(b) == 0 for b in books)
    assert vector_codes(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>"))[0].first().error == 0
