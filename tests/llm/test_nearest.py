import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.nearest import BinaryCoder, allowance, hamming, learned_reach, nearest, probed_keys


@pytest.mark.parametrize("width", [8, 16, 32])
def test_probing_retrieves_every_code_within_the_radius(width):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, size=(300, 8), dtype=np.uint8)
    codes[:200] = codes[0] ^ (rng.random((200, 64)) < rng.random((200, 1)) * 0.4).reshape(200, 8, 8).dot(1 << np.arange(8)).astype(np.uint8)
    m = 64 // width
    own = probed_keys(codes, width, 0)
    assert (own >> width == np.arange(m)).all()
    for radius in (0, m - 1, m, 3 * m - 1) if width > 16 else (0, m - 1, m, 2 * m + 1, 4 * m - 1):
        a = allowance(radius, m)
        assert m * (a + 1) - 1 >= radius and (a == 0 or m * a - 1 < radius)
        for c, keys in zip(codes[:6], probed_keys(codes[:6], width, a), strict=True):
            hit = np.isin(own, keys)
            assert hit.any(1)[hamming(codes, c) <= radius].all()
            # Each substring is probed within its own allowance, and no further.
            apart = np.bitwise_count(own ^ probed_keys(c[None], width, 0)).astype(int)
            assert (hit == (apart <= a)).all()


def brute(rows, k=10):
    """(query, rank) -> (vec_id, distance) over distinct (id, vector) rows; a query asks with its smallest vector."""
    usable = sorted({(i, tuple(map(float, v))) for i, v in rows})
    asked = {}
    for i, v in usable:
        if i % 100 == 0:
            asked.setdefault(i, v)
    x, ids = np.array([v for _, v in usable]), np.array([i for i, _ in usable])
    out = {}
    for q, v in asked.items():
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        for rank, (s, i) in enumerate(sorted((s, i) for s, i in zip(d.tolist(), ids.tolist(), strict=True) if i != q)[:k], 1):
            out[q, rank] = (i, s)
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[1000:] = x[3]  # a very common vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += rows[:1] * 3 + rows[100:101]  # repeated queries
    rows += [(6001, x[5].tolist())] + [(5, x[5].tolist())] * 20  # copies of one row don't push out another id
    rows += [(200, x[7].tolist())]  # an id with two vectors
    bad = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), (None, [1.0] * 16), (2500, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = nearest(df, F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    mine = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert len(mine) == len(got) and set(mine) == set(want)
    exact = {(i, round(s, 9), q) for (q, _), (i, s) in want.items()}
    assert sum((i, round(s, 9), q) in exact for (q, _), (i, s) in mine.items()) >= 0.9 * len(want)
    for q in {q for q, _ in mine}:
        order = [(mine[q, r][1], mine[q, r][0]) for r in range(1, 11)]
        assert order == sorted(order)


def test_reach_holds_what_the_sample_shows():
    """Within the radius that a distance asks for lie the codes of the stated share of the pairs that far apart or nearer."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    coder = BinaryCoder(x, 128)
    reach = np.array(learned_reach(coder, x, 0.95))
    assert len(reach) == 129 and (np.diff(reach) >= 0).all() and reach[-1] == np.inf
    y = x + rng.normal(size=x.shape) * rng.random((1500, 1)) * 0.8
    d, apart = np.sqrt(((x - y) ** 2).sum(1)), hamming(coder.codes(x), coder.codes(y))
    assert (apart <= (reach[None] < d[:, None]).sum(1)).mean() > 0.93


@pytest.mark.parametrize(
    ("clusters", "size", "noise", "most", "scans"),
    [(50, 40, 0.1, 0.1, False), (50, 40, 0.33, 0.3, False), (200, 10, 0.1, 0.3, False), (1, 2000, 1.0, 1.2, True)],
)
def test_each_query_looks_as_far_as_it_needs(spark, clusters, size, noise, most, scans):
    """Tight clusters, looser ones, and ones with fewer rows than neighbours are met in part only; isotropic rows about once."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(clusters, 32)), size, 0) + rng.normal(size=(clusters * size, 32)) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(x[rng.permutation(len(x))])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    assert len(got) == len(want)
    recall = sum(want[r.query_id, n][0] in {g.vec_id for g in got if g.query_id == r.query_id} for r in got if r["rank"] == 1 for n in range(1, 11)) / len(want)
    share = np.mean([r.met for r in got]) / len(rows)
    print(clusters, size, noise, "recall", recall, "share of rows met", share, "radius", np.mean([r.radius for r in got]))
    assert recall >= 0.9 and share < most and all(r.scanned == scans for r in got if scans)


def test_queries_short_of_neighbours_read_all_codes(spark):
    """Rows far from each other: nothing is retrieved at first, so all codes are read; the answer is exact where the radius is whole."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(400, 8)), 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0, coverage=1.0, bits=64, block_rows=150, query_rows=3).collect()
    want = brute(rows)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {k: i for k, (i, _) in want.items()}


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.5]), (5, [3.0, 2.5])], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 3)) for r in got] == [(5, 0.5), (5, 2.062)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_codes_are_signs_of_rotations():
    x = np.random.default_rng(2).normal(size=(50, 8))
    assert BinaryCoder(x, 8).codes(x).shape == (50, 1)
    wide = BinaryCoder(x, 20)
    assert wide.turn.shape == (8, 20) and wide.codes(x).shape == (50, 3)
    assert np.allclose(wide.turn[:, :8].T @ wide.turn[:, :8], np.eye(8))
