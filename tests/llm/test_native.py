import hashlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from rankloom.llm import exact_dedup, mixing
from rankloom.llm.exact_dedup import exact_duplicates
from rankloom.llm.mixing import mix_sources

ROWS = [(1, "a b"), (2, "ab "), (3, "ab"), (4, None), (5, ""), (6, " \t\x0b"), (7, "x y z"), (7, "x y z"), (None, "x y z"), (8, "A b"), (9, "a b")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")].append((i, t or ""))
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        left = [True]
        for i, t in sorted(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
            out.append((i, best[0], len(g), bool(left and left.pop()), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [False, True])
def test_exact_duplicates(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(exact_dedup, "SAMPLE", 1.0)
        monkeypatch.setattr(exact_dedup, "HOT_SEEN", 2)
        monkeypatch.setattr(exact_dedup.hot_texts, "__defaults__", (1.0, 7))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], "doc_id long, text string, keep_id string, _sha int")
    got = exact_duplicates(docs, salts=3)
    assert got.columns[:2] == ["doc_id", "text"]
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(map(str, rows)) == brute(ROWS)


def test_exact_duplicates_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_targets_and_cuts(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i < 5 else "b" if i < 40 else None) for i in range(60)] + [(60, None, "empty"), (61, "", "empty")]
    got = mix_sources(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")).collect()
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for source, g in by.items():
        assert {r.source_size for r in g} == {sum(r["size"] for r in g)}
        assert abs(sum(r.taken for r in g) - g[0].target) <= 0.5, source
        assert g[0].target <= 3 * g[0].source_size
    assert abs(sum(g[0].target for g in by.values()) - total) < 1e-6
    assert got and sorted(map(str, got)) == sorted(map(str, mix_sources(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")).collect()))


def test_mixing_splits_one_id_of_very_many_rows(spark, monkeypatch):
    """100,000 rows of one id and 30,000 of none: the same words are taken as by one sort, and no range holds many rows."""
    many = spark.range(100_000).select(F.lit(77).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("w "), (F.col("id") % 4).cast("int")), F.lit("end"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 5 > 0, "a").alias("source"))
    none = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("x y "), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source"))
    some = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    docs = many.unionByName(none).unionByName(some).repartition(8)
    plain = mix_sources(docs)
    monkeypatch.setattr(mixing, "HOT_ROWS", 5000)
    split = mix_sources(docs)
    told = lambda df: sorted(map(str, df.groupBy("doc_id", "size", "source", "target", "taken").count().collect()))
    assert told(split) == told(plain)
    keyed = docs.select(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"), F.size(F.split("text", " ")).alias("_size"), F.xxhash64("doc_id", "text", "source").alias("_row"))
    hot = mixing.hot_keys(keyed)
    assert len(hot) == 2
    ranges = keyed.withColumn("_range", mixing.range_of(F.col("_key"), F.col("_size"), F.col("_row"), hot))
    assert ranges.groupBy("_range").count().agg(F.max("count")).first()[0] < 1000
    # Names sort as keys and sizes do.
    order = [(r._key, r._size) for r in ranges.where("_size > 0").select("_key", "_size", "_range").distinct().orderBy("_range").collect() if r._key in hot]
    assert order == sorted(order)


def test_mixing_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
