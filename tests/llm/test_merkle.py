import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm.merkle import folded, leaf_digest, merkle_manifest, siblings


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes, fan):
    """Root of a level and for each node its siblings up to there, level by level."""
    place, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for leaf_at, at in enumerate(place):
            run, i = runs[at // fan], at % fan
            proofs[leaf_at].append(("".join(run[:i]), "".join(run[i + 1 :])))
            place[leaf_at] = at // fan
        nodes = [H(*r) for r in runs]
    return nodes[0], proofs


def brute(rows, fan):
    """Sorted (doc_id, leaf, subroot, root, proof) of (doc_id, source, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    trees = [(s, sorted(groups[s]), *grown([r[2] for r in sorted(groups[s])], fan)) for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode()))]
    root, above = grown([t[2] for t in trees], fan)
    return sorted(map(str, ((r[3], r[2], sub, root, p + up) for (_, own, sub, proofs), up in zip(trees, above, strict=True) for r, p in zip(own, proofs, strict=True))))


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, text string, proof string, at int")


FIELDS = ("doc_id", "source", "text")


@pytest.mark.parametrize("fan, block", [(2, 4), (3, 9), (16, 256)])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_levels_built_plainly(spark, fan, block, seed):
    rng = random.Random(seed)
    sizes = {"hot": 300, None: 5, "": 1, "é": 17, "z" * 90: 16, "b": 2, "B": block, "c": block + 1, "d": 1}
    rows = [(i, s, rng.choice([None, "", "x" * rng.randrange(70), "ünï"])) for s, n in sizes.items() for i in rng.sample(range(10**6), n)]
    rows += [rows[0]] * 3 + [(None, "hot", "a"), (None, "hot", None), (None, None, None)]  # repeated rows, null ids
    rng.shuffle(rows)
    got = merkle_manifest(table(spark, rows).repartition(6), FIELDS, fan=fan, block=block, carry={"twice": F.col("doc_id") * 2, "top": F.col("text")})
    assert got.columns == ["doc_id", "twice", "top", "leaf", "subroot", "root", "proof"]
    mine = got.withColumn("fold", folded(F.col("leaf"), F.col("proof"))).withColumn("all", siblings(F.col("proof"))).collect()
    want = brute(rows, fan)
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, [(p.before, p.after) for p in r.proof])) for r in mine) == want
    assert all(r.fold == r.root and r.twice == (r.doc_id and 2 * r.doc_id) for r in mine)
    assert all(r["all"] == "".join(p.before + p.after for p in r.proof) for r in mine)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = [(i, "ab"[i % 2], "Text") for i in range(40)]
    got = merkle_manifest(table(spark, rows), FIELDS, carry={"other": leaf_digest("doc_id", "source", F.lower("text"))})
    assert got.where(folded(F.col("other"), F.col("proof")) == F.col("root")).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, "long " * 50_000)], [(i, str(i), "t") for i in range(40)]])
def test_one_row_and_groups_of_one_row(spark, rows):
    got = merkle_manifest(table(spark, rows), FIELDS)
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof])) for r in got.collect()) == brute(rows, 16)


def test_empty(spark):
    got = merkle_manifest(table(spark, []), FIELDS, carry={"x": F.col("at")})
    assert got.count() == 0 and got.columns == ["doc_id", "x", "leaf", "subroot", "root", "proof"]
