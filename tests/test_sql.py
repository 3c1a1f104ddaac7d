"""Registered queries against their SQL, on small tables that hold what the driver's smallest ones lack."""

import datetime as dt
import subprocess
import sys
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.functions.text import file_size_label, tenths
from rankloom.operators import buckets, dictionary, features, ranking
from rankloom.sources import documents
from rankloom.streaming import events


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def equal(spark, sf, name, *tables):
    got = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    return rows


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
DAY = dt.datetime(1996, 3, 6)


def test_sizes_beyond_a_gigabyte(spark, tmp_path):
    """the query's labels end at MB; the function's own end at TB."""
    orders = [(k, 1, "O", 1.0, DAY, "1-URGENT") for k in (0, 4, 1000, 1048579, 8999999)]
    rows = equal(spark, write(spark, tmp_path, orders=(orders, ORDERS)), "screen_labels", "orders")
    assert {r[1] for r in rows if r[0] > 10**6} == {"1024 MB", "8789.1 MB"}
    assert spark.range(1).select(file_size_label(F.lit(1 << 30))).first()[0] == "1 GB"


def test_tenths_are_those_of_the_binary_value(spark):
    """ten times the value is rounded, as in the SQL and in the code to match."""
    xs = [1.8499999999999999, 3.4499999999999997, 31.849999999999998, 58.85, 0.25, float("nan")]
    wanted = [duckdb.execute("SELECT round(?::DOUBLE, 1)", [x]).fetchone()[0] for x in xs]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(tenths(F.col("x"))).collect()]
    assert repr(got) == repr(wanted) and got[:3] == [1.9, 3.5, 31.9]


def test_listing_places_rows_without_notes_last(spark, tmp_path):
    """a résumé listed twice, by its candidate's row without notes and by its own."""
    orders = [(2, 7, "O", 9.0, DAY, None), (502, 7, "O", 9.0, DAY, "1-URGENT"), (3, 7, "F", 1.0, DAY, None)]
    customers = [(2, "Customer#2", 1, 0.0, "BUILDING"), (7, "Customer#7", 1, 0.0, "FURNITURE")]
    items = [(k, 17.0) for k in (2, 502, 3)]
    sf = write(spark, tmp_path, orders=(orders, ORDERS), customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"), lineitem=(items, "l_orderkey long, l_quantity double"))
    rows = equal(spark, sf, "candidate_listing", "orders", "customer", "lineitem")
    assert [r[8] for r in sorted(rows, key=lambda r: r[-1]) if r[1] == 502] == ["1-URGENT", None]


def test_texts_and_their_runs_are_not_broadcast(spark, tmp_path):
    """of a lookup only a counted catalog is broadcast, whatever the files' sizes say of the texts."""
    spark.range(2000).selectExpr("id", "concat('term ', id % 7, ' and ', id % 3) AS text").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    for most, wanted in ((dictionary.BROADCAST_BYTES, 1), (0, 0)):
        catalog = spark.createDataFrame([(1, "Term 3"), (2, "and 2"), (3, "none")], "place int, term string")
        held, dictionary.BROADCAST_BYTES = dictionary.BROADCAST_BYTES, most
        try:
            found = dictionary.found_terms(texts, catalog)
        finally:
            dictionary.BROADCAST_BYTES = held
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == wanted
        assert found.where("terms = array('Term 3', 'and 2')").count() == sum(i % 7 == 3 and i % 3 == 2 for i in range(2000))


def test_a_finished_batch_is_not_staged_again(spark, tmp_path, monkeypatch):
    """the second landing of a batch counts its events and writes nothing."""
    path = f"file://{tmp_path}/events"
    rows = spark.range(200).selectExpr("concat('e', id) AS id", "'resume-queued' AS event")
    assert events.land_events(rows, path, 0, 4)["resume-queued"] == 200
    monkeypatch.setattr(buckets, "staged_rows", None)
    assert events.land_events(rows, path, 0, 4)["resume-queued"] == 200
    assert buckets.read_buckets(spark, path).count() == 200


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_rebuilt_where_they_are_read(spark, tmp_path):
    """F8: no token becomes a row and no text goes to Python; a text of many dated lines and one of many bullets are whole."""
    texts = [None, "", "• SUMMARY", "a b 2019 – 2020 c d - Present • x Senior Engineer 2001 - 2004 y", "Acme Jan 2019 – Present " * 3000, "• one 1. two PhD " * 3000, "word " * 20000 + "SKILLS & x SKILLS"]
    sf = write(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    for name in ("normalize_rows", "normalize_text"):
        rows = dict(equal(spark, sf, name, "documents"))
        assert rows[4].count("\n") == 2999 and rows[5].count("\n\n") == 3000
        found = plan(entry.queries()[name](spark, sf))
        assert not any(step in found for step in ("Window", "Generate", "Python", "hashpartitioning"))


def test_pages_are_rebuilt_without_python(spark, tmp_path):
    """pages are rebuilt in the plan, so no batch of texts is held by Python."""
    turns = [(1, 1, "u", "SKILLS • Rust"), (1, 3, "a", "Acme 2019 – Present more"), (1, 4, "u", "Acme 2019 – Present more"), (1, 6, "a", None), (2, 3, "u", " "), (3, 0, "u", "• PhD of x")]
    sf = write(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    equal(spark, sf, "page_combine_layout", "conversations")
    assert "Python" not in plan(entry.queries()["page_combine_layout"](spark, sf))


def test_a_page_is_rebuilt_once(spark, tmp_path):
    """the plan holds the rebuilding once and one shuffle by document; empty pages, repeats around them and a null document are as in the SQL."""
    turns = [(1, 0, "u", "a"), (1, 1, "u", " \t"), (1, 2, "u", "a"), (1, 4, "u", None), (1, 5, "u", "b"), (1, 7, "u", "a"), (2, 0, "u", None), (2, 3, "u", ""), (None, 1, "u", "c"), (None, 2, "u", None)]
    sf = write(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    rows = dict(equal(spark, sf, "page_combine_layout", "conversations"))
    assert rows == {1: "a\n\nb\n\na", 2: "", None: ""}
    found = plan(entry.queries()["page_combine_layout"](spark, sf))
    assert found.count("PROFESSIONAL\\ SUMMARY") == 1 and found.count("hashpartitioning") == 1


def test_records_are_rebuilt_where_they_are_made(spark, tmp_path):
    """records of all kinds equal the SQL; no token becomes a row, nothing is grouped or sorted."""
    customers = [(k, f"Customer#{k}", k % 25, 0.0, "BUILDING") for k in (*range(130), 900000)]
    sf = write(spark, tmp_path, customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    equal(spark, sf, "normalize_records", "customer")
    found = plan(entry.queries()["normalize_records"](spark, sf))
    assert not any(step in found for step in ("Window", "Generate", "Aggregate", "Sort", "Python"))


def test_shown_records_are_dealt_out(spark, tmp_path):
    """records of one small file are rebuilt by all tasks in both layouts, not by the one that reads them."""
    customers = [(k, f"Customer#{k}", k % 25, 0.0, "BUILDING") for k in range(130)]
    sf = write(spark, tmp_path, customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    equal(spark, sf, "display_layout", "customer")
    for name in ("normalize_records", "display_layout"):
        found = plan(entry.queries()[name](spark, sf))
        assert "RoundRobinPartitioning" in found and found.index("PROFESSIONAL\\ SUMMARY") < found.index("RoundRobinPartitioning")


def test_scores_of_a_block_are_held_in_parts():
    """a full block of rows and its queries are scored in a few MB, with the rows that all scores at once give."""
    some = np.random.default_rng(3).normal(size=(8192 + 500, 16)).astype(np.float32)
    some[100:200] = some[5]
    rows, asked = pd.DataFrame({"k": range(8192), "v": list(some[:8192])}), pd.DataFrame({"q": range(500), "v": list(some[8192:])})
    tracemalloc.start()
    got = ranking.best_of(rows, asked, 5, "query_id", "vec_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = ranking.cosine_matrix(asked["v"], rows["v"])
    assert got["vec_id"].tolist() == np.argsort(-score, axis=1, kind="stable")[:, :5].ravel().tolist() and peak < 40 << 20


class Sent:
    """Stands for files: gives the function of their tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):  # noqa: N802
        return task


def test_texts_of_files_are_sent_on_as_they_come(spark, tmp_path):
    """a task holds few texts, whatever a batch holds; its code loads no pandas; every file has its row."""
    task = documents.extract_texts(Sent())
    files = [(f"f{n}.docx", documents.docx_file("word " * (1 if n < 600 else 100_000))) for n in range(620)] + [("x.odt", b"")]
    batch = pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files])], names=["path", "content"])
    got = list(task(iter([batch, batch.slice(0, 3)])))
    assert [p for b in got for p in b.column(0).to_pylist()] == [f[0] for f in files] + [f[0] for f in files[:3]]
    assert max(b.num_rows for b in got) == documents.SENT_FILES and max(b.get_total_buffer_size() for b in got) < 2 << 20
    code = "import rankloom.sources.documents, sys; assert 'pandas' not in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
    turns = [(c, t, "u", x) for c in (1, 3, 4) for t, x in enumerate(["SKILLS • Rust & <b>", "x", None, "y", None])]
    equal(spark, write(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string")), "files_dispatched", "conversations")


def test_lines_are_summed_as_they_are_stored(spark, tmp_path):
    """an order's lines in two files are summed in their order, as the SQL does on one thread; an order stored twice is ranked once."""
    orders = [(2, 7, "O", 9.0, DAY, "1-URGENT"), (3, 7, "F", 1.0, DAY, None), (3, 7, "F", 1.0, DAY, None), (3, 8, "F", 1.0, DAY, None)]
    sf = write(spark, tmp_path, orders=(orders, ORDERS))
    files = [[(2, 24.0, 0.03, 0.08), (2, 31.0, 0.0, 0.08), (3, None, 0.01, 0.0)], [(2, 14.0, 0.1, 0.07), (2, 11.0, 0.03, 0.08), (3, 4.0, None, 0.01)]]
    (tmp_path / "lineitem.parquet").mkdir()
    for n, lines in enumerate(files):
        spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        next((tmp_path / f"{n}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{n}.parquet")
    got = entry.queries()["hybrid_ranking"](spark, sf)
    con = duckdb.connect(config={"threads": 1})
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['hybrid_ranking']})").fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(wanted) and [r[:3] for r in rows] == [(7, 2, 38.5), (7, 3, rows[1][2]), (8, 3, rows[1][2])]


def test_only_totals_of_features_leave_a_task(spark, tmp_path, monkeypatch):
    """a text's features are totalled where it is read, no array of them is sent on; marked words that are parts, pairs, ties, letters of 2 to 4 bytes and runs of texts are as in the SQL."""
    texts = [None, "", " \n_\n", "the a x", "abcd #abc #abcd #bcd #abcde ##abc #ab #", "#ABCD_abcdef\n\n__\nc++ .net a.b\tc# x1", "größe 東京都庁舎 𐐨𐐩𐐪 𝒜𝒷 naïve-naïve", "one two three four five\n" * 9, "zz yy xx ww\n" + "w" * 300, "#東京都 東京都庁", *(f"w{n} abc{n % 7}def x{n % 3}\nlast w{n}" for n in range(40))]
    sf = write(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    rows = equal(spark, sf, "feature_weights", "documents")
    assert {r[0] for r in rows} == set(range(len(texts))) - {0, 1, 2, 3}
    found = plan(entry.queries()["feature_weights"](spark, sf))
    assert "MapInArrow" in found and "lambda" not in found
    for size in (1, 60):
        monkeypatch.setattr(features, "CHARS_AT_ONCE", size)
        assert [n for a, b in features._slices(texts) for n in range(a, b)] == list(range(len(texts)))
        assert [x for a, b in features._slices(texts) for x in features.totals(texts[a:b])[1]] == features.totals(texts)[1]


def test_a_first_batch_is_dealt_once(spark, tmp_path, monkeypatch):
    """the first landing stages nothing and shuffles rows once, one row of a key stays; events are stored without digests, a résumé's in one bucket, and read with their ids."""
    path, kinds = f"file://{tmp_path}/events", "resume_id long, job_id long"
    queued = spark.createDataFrame([(1, 7), (1, 7), (2, None), (None, 7)], kinds)
    extracted = spark.createDataFrame([(n, 7, "text", 1, 0, 1, None, None) for n in range(60)], f"{kinds}, method string, text_pages int, ocr_pages int, total_pages int, duration_ms long, error string")
    made = events.pipeline_events(queued, extracted, spark.createDataFrame([(n, n, 1.0) for n in range(0, 60, 2)], "resume_id long, candidate_id long, overall_score double"))
    with monkeypatch.context() as held:
        held.setattr(buckets, "staged_rows", None)
        assert events.land_events(made, path, 0, 4)[events.QUEUED] == 4
    dealt = plan(buckets._dealt(made.drop("id"), events.KEY, ["resume_id"], 4, None))
    assert dealt.count("hashpartitioning(_bucket") == 1 and dealt.count("Exchange") == plan(made).count("Exchange") + 1
    stored = spark.read.parquet(path)
    assert "id" not in stored.columns and stored.groupBy("resume_id").agg(F.count_distinct("_bucket").alias("n")).agg(F.max("n")).first()[0] == 1
    told = lambda df: sorted(map(repr, df.select(sorted(made.columns)).collect()))
    assert told(events.read_events(spark, path)) == told(made.dropDuplicates(["id"]))
    more = events.pipeline_events(spark.createDataFrame([(1, 7), (99, 7)], kinds), extracted.limit(0), made.limit(0).select("resume_id", "candidate_id", "overall_score"))
    assert events.land_events(more, path, 1, 4)[events.QUEUED] == 2 and told(events.read_events(spark, path)) == told(made.unionByName(more).dropDuplicates(["id"]))
    # A table that holds ids stays one.
    old = f"file://{tmp_path}/old"
    buckets.upsert_buckets(made.limit(50), old, ["id"], 0, 4)
    events.land_events(made, old, 1, 4)
    assert told(events.read_events(spark, old)) == told(made.dropDuplicates(["id"]))
