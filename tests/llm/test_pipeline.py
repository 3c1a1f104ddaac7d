import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm.queries import vocabulary
from tests.llm.test_minhash_forest import brute as near_brute


def documents():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)]
    rows, labels = [], []
    for i in range(700):
        w = rng.choices(words, k=rng.randint(10, 60))
        if i % 9 == 0:
            w += ["vile", "rotten"]
        if i % 2:
            labels.append((i, int(i % 9 == 0)))
        rows.append((i, (" \n" if i % 7 == 0 else "") + " ".join(w), "en", f"s{i % 5}" if i % 11 else None))
    for i in range(700, 760):  # exact copies but for white space, and near copies
        w = rows[i - 699][1].split()
        if i % 2 and len(w) > 30:
            w[0] = "edited"
        rows.append((i, "  ".join(w), "en", "s1"))
    rows += [(800, None, None, "s2"), (801, "", "en", "s2"), (None, "one two three", None, None)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = documents()
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = now.collect()
    # Toxicity: exactly the rows with the two marked words go.
    want = [r for r in rows if "rotten" not in (r[1] or "")]
    assert sorted(str(r.doc_id) for r in kept["toxicity"]) == sorted(str(r[0]) for r in want)
    groups = defaultdict(list)
    for r in want:
        groups["".join((r[1] or "").split())].append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])) for g in groups.values()]
    assert sorted(str(r.doc_id) for r in kept["exact_dedup"]) == sorted(str(r[0]) for r in want)
    classes = near_brute([(r[0], r[1]) for r in want])
    want = [r for r in want if any(str(r[0]) == i == c for i, c, *_ in classes)]
    assert sorted(str(r.doc_id) for r in kept["near_duplicates"]) == sorted(str(r[0]) for r in want)
    assert len(want) < len(kept["exact_dedup"])
    # Mixing: water level by halving, then documents in md5 order up to each budget.
    size = lambda r: len((r[1] or "").split())
    sources = sorted({r[3] for r in want}, key=lambda s: (s is None, s))
    total = {s: sum(size(r) for r in want if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * total[s], level * weight[s]) for s in sources) < sum(total.values()) else (low, level)
    expected = Counter()
    for s in sources:
        left = int(min(3 * total[s], low * weight[s]) + 0.5 + 1e-6)
        order = sorted((r for r in want if r[3] == s), key=lambda r: hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest())
        while left > 0:
            for r in order:
                n = min(left, size(r))
                left -= n
                if n:
                    expected[str(r[0]), " ".join(r[1].split()[:n])] += 1
    assert Counter((str(r.doc_id), " ".join(r.text.split())) for r in kept["mixing"]) == expected
    assert all(r.n_chars == len(r.text) for r in kept["mixing"])
    # Packing: every id once.
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = Counter(x for r in kept["mixing"] for x in [*t.encode(r.text, add_special_tokens=False).ids, 1])
    assert Counter(x for r in kept["packing"] for x in np.frombuffer(bytes(r.ids), "<u4").tolist()) == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_class_stays(spark):
    base = [f"w{k}" for k in range(40)]
    near = base[:39] + ["end"]
    rows = [(None, "lone text of its own here", "a"), (None, " ".join(base), "a"), (None, " ".join(near), "b"), (1, " ".join(base[::-1]), "c"), (1, " ".join([*base[:0:-1], "x"]), "c"), (2, None, None), (2, None, None), (3, " ", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    words = sorted(tuple(sorted((r.text or "").split()[:3])) for r in got)
    assert len(got) == 4 and len(set(words)) == 4


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    from rankloom.llm import common

    docs = spark.createDataFrame([(k, f"text number {k} of some words", "en", "s", 9) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mark = common.tables_mark()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = common.tables_since(mark)
    assert len(left) == 1 and "pipeline-mixing" in left[0]
    common.drop_tables(spark, left)
