"""Writes, read models, files, the screening plan and streams."""

import datetime as dt
import io
import math
import random
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.functions import vectors
from rankloom.operators import ranking, store, views
from rankloom.operators.cascade import REFERENCES, Reference, deleted
from rankloom.operators.buckets import bucket_of, looked_up, read_buckets, upsert_buckets
from rankloom.operators.topk import similar_pruned as ranking_topk
from rankloom.plans.answers import answered_prompts
from rankloom.plans.screening import generated, screened
from rankloom.sources import documents as sources
from rankloom.sources.pages import extract_by_page
from rankloom.streaming import events, work

T0 = dt.datetime(2024, 1, 1)



def made(spark, table, /, **columns):
    """Rows of a table from columns given as lists; the rest is null."""
    n = len(next(iter(columns.values())))
    fields = [f for f in schemas.schema(table).fields if f.name in columns]
    data = [tuple(columns[f.name][i] for f in fields) for i in range(n)]
    return schemas.conformed(spark.createDataFrame(data, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)), table)


@pytest.fixture
def tables(spark):
    return {
        "jobs": made(spark, "jobs", id=["j1", "j2"], title=["One", "Two"], description=["d", "e"], status=["active", "archived"], min_experience_years=[2.0, None], experience_required_years=[None, 3.0], updated_at=[T0, T0]),
        "job_skills": made(spark, "job_skills", id=["1", "2"], job_id=["j1", "j1"], skill=["Rust", "Go"], importance=["required", "preferred"]),
        "candidates": made(spark, "candidates", id=["c1", "c2"], name=["Ann", "Bob"], email=["ann@x.org", None]),
        "resumes": made(spark, "resumes", id=["r1", "r2", "r3"], candidate_id=["c1", None, "c2"], job_id=["j1", "j1", "j2"], file_name=["a.pdf", "b.pdf", "a.pdf"], file_path=["/a", "/b", "/c"], file_size=[100, 200, 100], status=["completed", "queued", "completed"], uploaded_at=[T0, T0 + dt.timedelta(1), T0]),
        "candidate_analysis": made(spark, "candidate_analysis", id=["a1"], candidate_id=["zz"], job_id=["j1"], resume_id=["r1"], overall_score=[80.0]),
        "shortlists": made(spark, "shortlists", id=["s1", "s2"], job_id=["j1", "j1"], candidate_id=["c1", "r2"], status=["shortlisted", "rejected"], notes=["good", None]),
        "processing_queue": made(spark, "processing_queue", id=["q1", "q2"], job_id=["j1", "j1"], resume_id=["r1", "r2"], priority=[0, 1], attempts=[1, 0], status=["processing", "queued"], queued_at=[T0, T0]),
        "embeddings": made(spark, "embeddings", id=["e1"], resume_id=["r1"], job_id=["j1"], embedding=[[1.0, 0.0]]),
        "job_embeddings": made(spark, "job_embeddings", job_id=["j1", "j2"], embedding=[[1.0], [2.0]]),
    }


def test_summary_and_listing(spark, tables):
    s = views.job_summary(tables["jobs"], tables["resumes"], tables["shortlists"]).collect()
    assert [(r.id, r.candidate_count, r.shortlisted_count, r.processing_count, r.experience_required_years) for r in s] == [("j1", 2, 1, 1, 2.0)]
    listed = views.candidate_listing(*(tables[n] for n in ("resumes", "candidates", "candidate_analysis", "shortlists"))).where("job_id = 'j1'")
    got = listed.orderBy(*views.listing_order()).collect()
    assert [(r.id, r.name, r.shortlist_status, r.notes) for r in got] == [("c1", "Ann", "shortlisted", "good"), ("r2", "b.pdf", "rejected", None)]
    assert got[0].analysis.candidate_id == "c1" and got[1].analysis is None
    assert [r.id for r in views.sorted_listing(listed, "name").collect()] == ["c1", "r2"]
    assert views.searched(listed, "ANN@X").count() == 1
    assert views.searched(listed, "", "rejected").count() == 1
    assert views.searched_jobs(tables["jobs"], "tw", "archived").count() == 1
    assert store.patched(listed, "r2", "pending", "later").where("notes = 'later'").count() == 1
    detail = views.candidate_detail(*(tables[n] for n in ("resumes", "candidates", "candidate_analysis", "shortlists")), "j1", "c1").first()
    assert detail.file_path == "/a"
    assert views.job_with_skills(tables["jobs"], tables["job_skills"]).where("id = 'j1'").first().skills[1].skill == "Go"


def test_queue(spark, tables):
    q = tables["processing_queue"]
    assert tuple(views.processing_status(schemas.empty(spark, "processing_queue"), "j1").first()) == (0, 0, 0, 0, 0)
    assert views.progress(views.processing_status(q, "j1")).first().seconds_left == 16
    changes = spark.createDataFrame([("r1", "failed", "bad"), ("r2", "processing", None)], "resume_id string, status string, error_message string")
    now = {r.resume_id: r for r in store.queue_status(q, changes).collect()}
    assert (now["r1"].status, now["r1"].error_message, now["r1"].completed_at is not None) == ("failed", "bad", True)
    assert (now["r2"].status, now["r2"].attempts, now["r2"].started_at is not None) == ("processing", 1, True)
    assert {r.status for r in store.reconciled(q).collect()} == {"queued"}
    resumes, queue = store.retried(tables["resumes"], q, F.col("id") == "r1")
    assert queue.count() == 2 and queue.where("resume_id = 'r1' AND status = 'queued' AND attempts = 0").count() == 1
    assert resumes.where("id = 'r1'").first().status == "queued"
    many = spark.createDataFrame([("r1", "queued", None, 3), ("r1", "failed", "x", 2), ("r1", "processing", None, 1), ("r2", "paused", "hold", 1), ("r2", None, "?", 2), ("zz", "failed", "no such entry", 1)], "resume_id string, status string, error_message string, n int")
    now = {r.resume_id: r for r in store.queue_status(q, many, "n").collect()}
    assert len(now) == q.count() and (now["r1"].status, now["r1"].attempts, now["r1"].error_message, now["r1"].completed_at is not None) == ("queued", 2, None, True)
    assert (now["r2"].status, now["r2"].attempts, now["r2"].error_message) == ("paused", 0, "hold")
    done = store.resume_status(tables["resumes"], many.withColumnRenamed("resume_id", "id"), "n")
    assert done.count() == 3 and [tuple(r) for r in done.where("id = 'r1'").select("status", "error_message", F.col("processed_at").isNotNull()).collect()] == [("queued", None, True)]
    done = store.resume_status(tables["resumes"], spark.createDataFrame([("r2", "failed", "x")], "id string, status string, error_message string"))
    assert done.where("id = 'r2' AND processed_at IS NOT NULL AND error_message = 'x'").count() == 1
    assert views.queue_order(store.reconciled(q)).first().id == "q2"


def test_upserts(spark, tables):
    arrivals = made(spark, "candidates", id=["n1", "n2", "n3", "n4"], name=["Anne", "Cy", "Cyd", "Di"], email=[" ANN@x.org ", "cy@x.org", "CY@x.org", " "], phone=[None, "1", None, None]).withColumn("arrival", F.substring("id", 2, 1).cast("int"))
    stored = tables["candidates"].withColumn("phone", F.when(F.col("id") == "c1", "9"))
    got = {r.id: r for r in store.upserted_candidates(stored, arrivals).collect()}
    assert set(got) == {"c1", "c2", "n2", "n4"}
    assert (got["c1"].name, got["c1"].phone, got["n2"].name, got["n2"].phone) == ("Anne", "9", "Cyd", "1")
    # Stored candidates that share an e-mail stay; the smallest id is updated.
    shared = stored.unionByName(made(spark, "candidates", id=["c0", "c9"], name=["Ann Two", "Zed"], email=["Ann@X.org", "zed@x.org"]))
    got = {r.id: (r.name, r.phone) for r in store.upserted_candidates(shared, arrivals).collect()}
    assert got["c0"] == ("Anne", None) and got["c1"] == ("Ann", "9") and got["c9"] == ("Zed", None) and len(got) == 6
    texts = store.resume_texts(tables["resumes"], spark.createDataFrame([("r1", "read"), ("zz", "x")], "id string, raw_text string"))
    assert {r.id: r.raw_text for r in texts.collect()} == {"r1": "read", "r2": None, "r3": None}
    linked = store.resume_candidates(tables["resumes"], spark.createDataFrame([("r2", "c1"), ("r3", None)], "id string, candidate_id string"))
    assert {r.id: r.candidate_id for r in linked.collect()} == {"r1": "c1", "r2": "c1", "r3": None}
    more = made(spark, "candidate_analysis", id=["a2", "a3", "a9"], candidate_id=["c", "d", "e"], job_id=["j1", "j1", "j1"], resume_id=["r2", "r5", "r1"], overall_score=[90.0, None, 85.0])
    twice = store.upserted_analysis(store.upserted_analysis(tables["candidate_analysis"], more), more).collect()
    assert {r.resume_id: (r.id, r.rank, r.overall_score) for r in twice} == {"r1": ("a1", 2, 85.0), "r2": ("a2", 1, 90.0), "r5": ("a3", 3, None)}
    short = store.upserted(tables["shortlists"], made(spark, "shortlists", id=["s9"], job_id=["j1"], candidate_id=["c1"], status=["pending"]), ["job_id", "candidate_id"], fill=("notes",))
    assert [(r.id, r.status, r.notes) for r in short.where("candidate_id = 'c1'").collect()] == [("s1", "pending", "good")]
    changed = made(spark, "jobs", id=["j1"], title=["New"], description=["x"], status=["active"])
    out = store.updated_jobs(tables["jobs"], tables["job_skills"], tables["job_embeddings"], changed, made(spark, "job_skills", id=["7"], job_id=["j1"], skill=["SQL"], importance=["required"]))
    assert out["jobs"].where("id = 'j1'").first().title == "New" and out["jobs"].count() == 2
    assert out["job_skills"].first().skill == "SQL" and [r.job_id for r in out["job_embeddings"].collect()] == ["j2"]
    assert store.archived(tables["jobs"], ["j1"]).where("status = 'archived'").count() == 2
    doubled = made(spark, "job_skills", id=["1", "2"], job_id=["j", "j"], skill=["Go", " go"], importance=["required", "required"])
    assert [r.id for r in views.distinct_skills(doubled).collect()] == ["1"]
    assert views.valid_jobs(tables["jobs"]).first().problems == ["description"]


def test_deletes(spark, tables):
    out, paths = store.deleted_jobs(tables, spark.createDataFrame([("j2",)], "job_id string"))
    assert [r.file_path for r in paths.collect()] == ["/c"]
    assert [r.id for r in out["candidates"].collect()] == ["c1"] and out["resumes"].count() == 2
    out = store.deleted_resumes(tables, spark.createDataFrame([("r1",)], "resume_id string"))
    assert out["candidate_analysis"].count() == out["embeddings"].count() == 0 and out["processing_queue"].count() == 1
    assert [r.id for r in out["candidates"].collect()] == ["c2"]
    assert [r.id for r in store.orphan_candidates(tables["candidates"], tables["resumes"].where("id = 'r1'")).collect()] == ["c2"]


def test_a_table_joins_the_cascade_by_declaration(spark, tables):
    """A table that hangs on another by a declared reference alone; a chain of two; a link that is cut; a ring."""
    notes = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3"), (4, None)], "note int, resume_id string")
    marks = spark.createDataFrame([(1, 1), (2, 3)], "id int, note int")
    seen = spark.createDataFrame([("x", "c2"), ("y", "c1"), ("z", None)], "id string, candidate_id string")
    more = (*REFERENCES, Reference("notes", "resume_id", "resumes"), Reference("marks", "note", "notes", "note"), Reference("seen", "candidate_id", "candidates", deleted="null"))
    out, paths = store.deleted_jobs(tables | {"notes": notes, "marks": marks, "seen": seen}, spark.createDataFrame([("j2",)], "job_id string"), more)
    assert [r.note for r in out["notes"].orderBy("note").collect()] == [1, 2, 4] and [r.id for r in out["marks"].collect()] == [1]
    assert {tuple(r) for r in out["seen"].collect()} == {("x", None), ("y", "c1"), ("z", None)} and [r.file_path for r in paths.collect()] == ["/c"]
    for name, df in store.deleted_jobs(tables, spark.createDataFrame([("j2",)], "job_id string"))[0].items():
        assert sorted(map(str, out[name].collect())) == sorted(map(str, df.collect())), name
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id int, up int")
    hung = spark.createDataFrame([(1, 4), (2, 6)], "id int, of int")
    ring = (Reference("tree", "up", "tree"), Reference("hung", "of", "tree"))
    left, lost = deleted({"tree": tree, "hung": hung}, {"tree": spark.createDataFrame([(2,)], "id int")}, ring)
    assert sorted(r.id for r in left["tree"].collect()) == [1, 5, 6] and [r.id for r in left["hung"].collect()] == [2] and sorted(r.id for r in lost["tree"].collect()) == [2, 3, 4]


def test_only_touched_jobs_are_ranked_anew(spark, monkeypatch):
    rows = [(f"a{n}", f"r{n}", f"j{n % 40}" if n % 41 else None, float(n * 7 % 50), n) for n in range(400)]
    stored = spark.createDataFrame(rows, "id string, resume_id string, job_id string, overall_score double, rank long")
    batch = spark.createDataFrame([("n1", "r1", "j1", 99.0), ("n2", "new", "j3", 1.0), ("n3", "none", None, 5.0)], "id string, resume_id string, job_id string, overall_score double")
    got = store.upserted_analysis(stored, batch, hot_rows=5)
    merged = store.upserted(stored.drop("rank"), batch, ["resume_id", "job_id"])
    again = {(r.resume_id, r.job_id): r["rank"] for r in ranking.ranked(merged, "job_id", "overall_score", "resume_id").collect()}
    for r in got.collect():
        old = next((x[4] for x in rows if x[1] == r.resume_id), None)
        assert r["rank"] == (again[r.resume_id, r.job_id] if r.job_id in ("j1", "j3", None) else old)
    assert got.count() == merged.count()
    # Jobs that the batch does not name pass through: a broadcast anti-join above the scan, and no shuffle.
    others = store.parted(stored, batch.select("job_id").distinct(), "job_id")[1]
    streamed = others._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in streamed and "LeftAnti" in streamed and "hashpartitioning" not in streamed and "Sort" not in streamed
    monkeypatch.setattr(store, "KEYS_SENT", 1)
    assert sorted(map(str, store.upserted_analysis(stored, batch, hot_rows=5).collect())) == sorted(map(str, got.collect()))


def test_duplicates_and_topk(spark, tables):
    files = spark.createDataFrame([("j1", "a.pdf", 100), ("j1", "a.pdf", 101), ("j9", "a.pdf", 100)], "job_id string, file_name string, file_size bigint")
    checked = views.duplicate_check(files, tables["resumes"])
    assert [r.existing_resume_id for r in checked.where("is_duplicate").collect()] == ["r1"]
    assert tuple(views.duplicate_counts(checked).first()) == (1, 2)
    v = spark.createDataFrame([("r1", [1.0, 0.0]), ("r2", [0.9, 0.1]), ("r3", [0.0, 1.0])], "resume_id string, embedding array<float>")
    top = ranking.similar(v, F.array(F.lit(1.0), F.lit(0.0)), 2).collect()
    assert [r.resume_id for r in top] == ["r1", "r2"] and top[1].similarity > 0.95
    with pytest.raises(ValueError, match="queries"):
        ranking.similar_for_each(v, v.toDF("query_id", "query_embedding"), most_queries=2)


def test_similar_for_more_queries_than_a_block(spark):
    """More queries than were once allowed, in several blocks."""
    v = spark.range(5000).select(F.col("id").alias("resume_id"), F.array(F.cos(F.col("id") / 900), F.sin(F.col("id") / 900)).alias("embedding"))
    few = v.where("resume_id < 40")
    got = ranking.similar_for_each(few, v.toDF("query_id", "query_embedding"), k=2, query_rows=1500, block_rows=16).collect()
    assert len(got) == 10000 and len({(r.query_id, r.rank) for r in got}) == 10000
    best = {r.query_id: r.resume_id for r in got if r.rank == 1}
    angle = lambda q, r: math.cos(q / 900 - r / 900)
    assert all(angle(q, r) >= max(angle(q, x) for x in range(40)) - 1e-12 for q, r in best.items())


@pytest.mark.parametrize("kind", ["clusters", "isotropic", "odd", "none regular"])
def test_pruned_topk_is_the_plain_one(spark, kind):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    x = rng.normal(size=(3000, 12)) if kind == "isotropic" else centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if kind == "odd":
        rows = rows[:300] + [(400 + i, rows[5][1]) for i in range(60)]  # many equal rows
        rows += [(900, None), (-1, []), (-2, [0.0] * 12), (902, [1.0, 2.0]), (903, [float("nan")] * 12), (904, [1e-20] * 12), (905, [-y for y in rows[5][1]])]
    if kind == "none regular":
        rows = [(1, None), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "resume_id long, embedding array<double>").repartition(7)
    asked = df.where("resume_id % 50 = 0 OR resume_id < 0 OR resume_id > 899 AND resume_id < 910 OR size(embedding) = 2").toDF("query_id", "query_embedding")
    got, scored = ranking_topk(df, asked, k=7, block_rows=200, query_rows=20)
    told = lambda d: sorted(str((r.query_id, r["rank"], r.resume_id, r.similarity if r.similarity is None else round(r.similarity, 12))) for r in d.collect())
    assert told(got) == told(ranking.similar_for_each(df, asked, k=7))
    share = scored.agg(F.sum("scored")).first()[0] / (asked.count() * len(rows))
    assert scored.count() == asked.count() and share <= 1
    if kind == "clusters":
        assert share < 0.1


def test_matrix_of_cosines_is_the_expression(spark):
    some = [None, [], [0.0, 0.0], [1.0, 2.0], [1.0, 2.0], [-3.0, 0.5], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(some)], "i int, v array<double>")
    pairs = df.join(df.toDF("j", "w")).select("i", "j", vectors.cosine_similarity(F.col("v"), F.col("w")).alias("c")).collect()
    got = ranking.cosine_matrix(some, some)
    for r in pairs:
        assert math.isclose(got[r.i, r.j], r.c or 0.0, abs_tol=1e-12)
    assert (got[3] == got[4]).all()


def test_versions(spark, tables, tmp_path):
    path = f"file://{tmp_path}/jobs"
    store.save(tables["jobs"], path)
    store.save(store.archived(store.load(spark, path), ["j1"]), path)
    assert store.load(spark, path).where("status = 'archived'").count() == 2


def docx(text):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


GOOD = "This page has more than ten plain words in its own text layer to read"


def pdf(content):
    """Pages parted by form feeds; IMG is an image-only page."""
    return [sources.Page(image=b"i") if p == "IMG" else sources.Page(text=p) for p in content.decode().split("\f") if p]


def test_files(spark, tmp_path):
    for name, content in {"a.docx": docx(["R&amp;D lead", "x"]), "b.doc": b"old", "c.txt": b"t", "d.pdf": f"{GOOD}\fIMG\f{GOOD}".encode(), "e.pdf": b"\f", "f.DOCX": b"broken"}.items():
        (tmp_path / name).write_bytes(content)
    files = sources.read_files(spark, f"file://{tmp_path}")
    assert sources.accepted(files).count() == 5
    got = {r.path.rsplit("/", 1)[1]: r for r in sources.extract_texts(files, pdf, sources.MockOcr("scanned words")).collect()}
    assert got["a.docx"].text == "R&D lead x" and got["a.docx"].error is None
    assert "Legacy" in got["b.doc"].error and "Unsupported file extension: .txt" in got["c.txt"].error
    assert (got["d.pdf"].method, got["d.pdf"].text_pages, got["d.pdf"].ocr_pages) == ("hybrid", 2, 1)
    assert got["d.pdf"].text == f"{GOOD}\n\nscanned words\n\n{GOOD}"
    assert "no pages" in got["e.pdf"].error and got["f.DOCX"].error
    landed = sources.landed(files, "j1", f"file://{tmp_path}/landed")
    assert landed.count() == 5 and landed.select("id").distinct().count() == 5
    (tmp_path / "plain").write_bytes(b"no extension")
    again = sources.landed(sources.read_files(spark, f"file://{tmp_path}", "[a-zA-Z]*").where("path NOT LIKE '%landed%'"), "j1", f"file://{tmp_path}/landed")
    assert again.where("file_name = 'plain'").first().file_type == "pdf"
    assert spark.read.parquet(f"file://{tmp_path}/landed").count() == 6  # the five are not kept twice
    native = {r.path.rsplit("/", 1)[1]: r for r in sources.extract_texts(files, pdf, native=True).collect()}
    assert native["d.pdf"].text == sources.rebuilt(f"{GOOD}\n\n{GOOD}\n") and "scanned" in native["e.pdf"].error


def test_hybrid_pages():
    page = sources.Page
    ocr = sources.MockOcr("read by eye")
    assert sources.hybrid_pages([page(GOOD)], ocr)["method"] == "text" and ocr.calls == 0
    assert sources.hybrid_pages([page(None, b"i")], ocr)["method"] == "ocr"
    failing = sources.MockOcr(error="Timeout")
    kept = sources.hybrid_pages([page("short text", b"i"), page(GOOD)], failing)
    assert (kept["text"], kept["text_pages"], kept["ocr_pages"]) == (f"short text\n\n{GOOD}", 1, 0)
    with pytest.raises(ValueError, match="scanned"):
        sources.hybrid_pages([page(None, b"i")], failing)


class Counting(sources.MockOcr):
    """Says in which task a page was read."""

    def extract_text(self, image):
        if image == b"fail":
            raise sources.OcrError("Timeout")
        return f" page {image.decode()} was read in task {TaskContext.get().partitionId()}, by these many words \n"


def test_pages_as_rows(spark):
    """Equal to files read whole; a file of 10,000 scanned pages is read by all tasks, in page order."""
    other = "\n".join(["EDUCATION", "one", "two three"])
    content = {"a.pdf": f"{GOOD}\fIMG\f{other}", "b.PDF": "IMG", "c.pdf": "", "d.pdf": f"{GOOD}\f{GOOD}\fshort", "e.pdf": " \f\n", "f.docx": "no zip", "g.txt": "x", "h.pdf": "short"}
    files = spark.createDataFrame([(k, v.encode()) for k, v in content.items()] + [("bad.pdf", b"\xff\xfe")], "path string, content binary")
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for ocr in (sources.MockOcr(text=" scanned words \n"), sources.MockOcr(error="Timeout"), sources.MockOcr(text=" "), None):
        assert told(extract_by_page(files, pdf, ocr)) == told(sources.extract_texts(files, pdf, ocr))
    scans = spark.createDataFrame([("big.pdf", b"x"), ("small.pdf", GOOD.encode())], "path string, content binary")
    many = lambda c: [sources.Page(image=b"fail" if n == 7 else str(n).encode()) for n in range(10_000)] if c == b"x" else pdf(c)
    got = {r.path: r for r in extract_by_page(scans, many, Counting(), tasks=12, layout=None).collect()}
    big = got["big.pdf"]
    assert (big.method, big.text_pages, big.ocr_pages, big.total_pages) == ("ocr", 0, 9999, 10_000) and got["small.pdf"].method == "text"
    pages = [p.split() for p in big.text.split("\n\n")]
    assert [int(p[1]) for p in pages] == [n for n in range(10_000) if n != 7]
    shares = Counter(p[6] for p in pages)
    assert len(shares) == 12 and max(shares.values()) < 1200


def test_screening(spark):
    resumes = spark.createDataFrame([("r1", "j", "Ann Lee\nann@x.org\n6 years of experience in Rust and SQL"), ("r2", "j", "Bob Ray\nbakes bread"), ("r3", "j", None)], "id string, job_id string, raw_text string")
    jobs = made(spark, "jobs", id=["j"], title=["Engineer"], description=["Rust and SQL engineer"], min_experience_years=[5.0])
    skills = made(spark, "job_skills", id=["1", "2"], job_id=["j", "j"], skill=["Rust", "SQL"], importance=["required", "required"])
    got = screened(resumes, jobs, skills).orderBy("rank").collect()
    assert [r.resume_id for r in got][0] == "r1" and [r.rank for r in got] == [1, 2, 3]
    assert got[0].skills_score == 100 and got[0].experience_score == 100 and got[0].name == "Ann Lee"
    assert "2 relevant" in got[0].strengths[0] and all(0 <= r.overall_score <= 100 for r in got)

    def generate(prompt):
        return '{"llm_score": 97, "summary": "fine", "skills": ["Go"]}' if "Ann Lee" in prompt else "no"

    hot = screened(resumes, jobs, skills, hot_rows=1)
    assert sorted((r.resume_id, r["rank"]) for r in hot.collect()) == sorted((r.resume_id, r["rank"]) for r in got)
    models = screened(resumes, jobs, skills, generate).orderBy("rank").collect()
    assert models[0].llm_score == 97 and models[0].ai_summary == "fine" and "Go" in models[0].extracted_skills
    assert generated(resumes, F.lit("x"), "id", lambda p: 1 / 0).where("answer IS NULL").count() == 3


def test_models_are_asked_once_and_again_without_a_summary(spark, tmp_path):
    resumes = spark.createDataFrame([("r1", "j", "Ann Lee\nRust"), ("r2", "j", "Bob Ray\nSQL")], "id string, job_id string, raw_text string")
    jobs = made(spark, "jobs", id=["j"], title=["Engineer"], description=["Rust engineer"])
    skills = made(spark, "job_skills", id=["1"], job_id=["j"], skill=["Rust"], importance=["required"])

    def generate(prompt):
        with open(f"{tmp_path}/asked", "a") as out:
            out.write(("analysis" if "llm_score" in prompt else "record") + (" again" if "Answer again" in prompt else "") + "\n")
        if "llm_score" not in prompt:
            return '{"name": "Known", "skills": ["Go"]}'
        return '{"llm_score": 88, "summary": "second try"}' if "Answer again" in prompt else '{"llm_score": 12, "summary": "  "}'

    got = screened(resumes, jobs, skills, generate).collect()
    assert {(r.llm_score, r.ai_summary, r.name) for r in got} == {(88.0, "second try", "Known")}
    asked = sorted(open(f"{tmp_path}/asked").read().split("\n")[:-1])
    assert asked == ["analysis", "analysis", "analysis again", "analysis again", "record", "record"]


def test_answers_are_kept_by_prompt(spark, tmp_path):
    """Equal prompts are asked once; a rerun asks what is open; calls are bounded in number and time; failures stay open."""
    log = tmp_path / "asked"
    log.touch()

    def model(prompts, down=(), slow=0.0):
        time.sleep(slow)
        with log.open("a") as f:
            f.write("".join(p + "\n" for p in prompts) + "--\n")
        if any(p in down for p in prompts):
            raise RuntimeError("down")
        return [None if p == "never" else "bad" if p.startswith("odd") else p + "!" for p in prompts]

    asked = lambda: [x for x in log.read_text().split("\n") if x and x != "--"]
    calls = lambda: log.read_text().count("--")
    rows = [(i, f"p{i % 20}") for i in range(400)] + [(400, None), (401, "odd"), (402, "never")]
    df = spark.createDataFrame(rows, "id int, p string").repartition(6)
    run = lambda m, **more: answered_prompts(df, F.col("p"), "id", m, f"file://{tmp_path}/answers", lambda a: a != "bad", lambda p, bad: f"again {bad} {p}", buckets=4, **more)
    first = {r.id: (r.answer, r.tries) for r in run(lambda ps: model(ps, ["p7"]), group=4, tasks=3).collect()}
    assert len(first) == 403 and first[400] == (None, 0) == first[402] and first[401] in (("again bad odd!", 2), (None, 0))
    assert Counter(asked())["p3"] == 1 and all(n == 1 for p, n in Counter(asked()).items())
    open_ = {r[1] for r in rows if r[1] and first[r[0]][0] is None}
    assert "p7" in open_ and len(open_) <= 6
    log.write_text("")
    second = {r.id: r.answer for r in run(model, group=4, tasks=3).collect()}
    assert set(asked()) - {"again bad odd"} == open_ and second[7] == "p7!" and second[27] == "p7!"
    log.write_text("")
    run(model)
    assert asked() == ["never"]
    # Bounds: each of two tasks makes at most two calls of three prompts, or stops after its time.
    log.write_text("")
    bounded = lambda path, **more: answered_prompts(df, F.concat("p", F.lit(" new")), "id", lambda ps: model(ps, slow=0.2), f"file://{tmp_path}/{path}", lambda a: True, lambda p, bad: p, group=3, tasks=2, **more)
    got = bounded("few", most_calls=2)
    assert calls() <= 4 and 0 < got.where("answer IS NOT NULL").select("answer").distinct().count() <= 12
    log.write_text("")
    bounded("short", seconds=0.3)
    assert calls() <= 4


def test_screening_keeps_answers(spark, tmp_path):
    log = tmp_path / "asked"
    log.touch()

    def generate(prompt):
        with log.open("a") as f:
            f.write("--\n")
        return '{"name": "Cy", "skills": ["Go"], "summary": "fine", "llm_score": 70}'

    resumes = spark.createDataFrame([("r1", "j", "Go Go 3 years"), ("r2", "j", "Go Go 3 years"), ("r3", "j", "Rust")], "id string, job_id string, raw_text string")
    jobs = spark.createDataFrame([("j", "T", "Go work", 1.0, None, None)], "id string, title string, description string, min_experience_years double, experience_required_years double, max_experience_years double")
    skills = spark.createDataFrame([("1", "j", "Go", "required")], "id string, job_id string, skill string, importance string")
    run = lambda: sorted(map(str, screened(resumes, jobs, skills, generate, f"file://{tmp_path}/a", buckets=2).drop("embedding").collect()))
    first = run()
    n = log.read_text().count("--")
    assert len(first) == 3 and n == 4  # two texts, two analyses
    assert run() == first and log.read_text().count("--") == n


def test_events_as_a_stream(spark, tmp_path):
    """Counts are observed for each batch and match the table; an event that lands twice is one row."""
    queued = spark.createDataFrame([("r1", "j"), ("r2", "j"), ("r3", "j")], "resume_id string, job_id string")
    extracted = spark.createDataFrame([("r1", "j", "ocr", 0, 2, 2, 5, None), ("r2", "j", None, None, None, None, None, "broken"), ("r3", "j", "text", None, None, None, None, None)], "resume_id string, job_id string, method string, text_pages int, ocr_pages int, total_pages int, duration_ms long, error string")
    analysed = spark.createDataFrame([("r1", "c1", 80.0), ("r2", "c2", 1.0)], "resume_id string, candidate_id string, overall_score double")
    made = events.pipeline_events(queued, extracted, analysed)
    kinds = [(r.resume_id, r.event, r.step) for r in made.orderBy("resume_id", "place").collect()]
    assert [k[1:] for k in kinds if k[0] == "r1"] == [(events.QUEUED, None), (events.STARTED, None), (events.STEP, "extracting"), (events.EXTRACTED, None), (events.STEP, "analyzing"), (events.COMPLETE, None)]
    assert [k[1] for k in kinds if k[0] == "r2"] == [events.QUEUED, events.STARTED, events.STEP, events.FAILED] and [k[1] for k in kinds if k[0] == "r3"] == [events.QUEUED, events.STARTED, events.STEP, events.STEP]
    counts = events.EventCounts()
    spark.streams.addListener(counts)
    try:
        for n in range(2):
            made.where(F.col("resume_id") <= f"r{n + 1}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = work.work_stream(spark, f"file://{tmp_path}/in/*", made.schema)
            events.event_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/check", buckets=4, available_now=True).start().awaitTermination()
        deadline = time.monotonic() + 20
        while sum(counts.total().values()) < 16 and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    assert counts.total() == {events.QUEUED: 3, events.STARTED: 3, events.STEP: 5, events.EXTRACTED: 2, events.FAILED: 1, events.COMPLETE: 2}
    assert read_buckets(spark, f"file://{tmp_path}/t").count() == 10
    assert events.land_events(made, f"file://{tmp_path}/t", 99, 4)[events.STEP] == 5 and read_buckets(spark, f"file://{tmp_path}/t").count() == made.count() == 14


def test_listing_by_two_kinds_of_shortlist_rows(spark):
    """A shortlist row names a candidate or a résumé; both, one, none, and an unknown candidate."""
    resumes = made(spark, "resumes", id=["r1", "r2", "r3", "r4"], candidate_id=["c1", "c2", "gone", None], job_id=["j"] * 4, file_name=["a", "b", "c", "d"])
    candidates = made(spark, "candidates", id=["c1", "c2"], name=["A", "B"])
    short = made(spark, "shortlists", id=["1", "2", "3", "4", "5"], job_id=["j", "j", "j", "j", "k"], candidate_id=["c1", "r1", "gone", "r4", "c2"], status=["x", "y", "z", "w", "v"])
    got = views.candidate_listing(resumes, candidates, made(spark, "candidate_analysis", id=["a"], resume_id=["none"], job_id=["j"]), short)
    assert sorted((r.resume_id, r.shortlist_status) for r in got.collect()) == [("r1", "x"), ("r1", "y"), ("r2", "pending"), ("r3", "pending"), ("r4", "w")]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "queued"), (2, "queued")], "id long, status string")
    events.write.parquet(f"{tmp_path}/in/a")
    stream = work.work_stream(spark, f"file://{tmp_path}/in/*", events.schema, 1)
    run = lambda: work.processed(stream, lambda df: df.withColumn("status", F.lit("completed")), f"file://{tmp_path}/out", ["id"], f"file://{tmp_path}/check", available_now=True).start().awaitTermination()
    run()
    spark.createDataFrame([(2, "queued"), (3, "queued")], "id long, status string").write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(tuple(r) for r in store.load(spark, f"file://{tmp_path}/out").collect()) == [(1, "completed"), (2, "completed"), (3, "completed")]


def test_batches_need_an_order_for_repeated_keys(spark, tmp_path):
    events = spark.createDataFrame([(1, "queued", 1), (1, "failed", 3), (1, "completed", 2)], "id long, status string, at long")
    events.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = work.work_stream(spark, f"file://{tmp_path}/in/*", events.schema)
    assert not store.saved(spark, f"file://{tmp_path}/out")
    work.processed(stream, lambda df: df, f"file://{tmp_path}/out", ["id"], f"file://{tmp_path}/check", available_now=True, order="at").start().awaitTermination()
    assert [r.status for r in store.load(spark, f"file://{tmp_path}/out").collect()] == ["failed"]
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"file://{tmp_path}/none")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.mark.parametrize("order", [None, "n"])
def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path, order):
    """Untouched files keep their names; a batch run again changes nothing; the rows equal an upsert of the whole table."""
    path, kinds = f"file://{tmp_path}/t", "id long, name string, first string, n int"
    rows = lambda ids, name, n=0: spark.createDataFrame([(i, name, name if i is None or i % 2 else None, n) for i in ids], kinds)
    one, two = rows([*range(200), None], "one"), rows([3, 4, 500], "two", 1).unionByName(rows([4], "two, later", 2) if order else rows([], "x"))
    assert upsert_buckets(one, path, ["id"], 7, 16, order, keep=("first",)) == list(range(16))
    before = files(tmp_path / "t")
    changed = upsert_buckets(two, path, ["id"], 8, 16, order, keep=("first",), fill=("name",))
    after = files(tmp_path / "t")
    assert 0 < len(changed) <= 3 and {f for f in before if int(f.split("=")[1].split("/")[0]) not in changed} == set(before) & set(after)
    assert all(before[f] == after[f] for f in set(before) & set(after))
    want = store.upserted(one.where("id IS NOT NULL"), two, ["id"], keep=("first",), fill=("name",), order=order).unionByName(one.where("id IS NULL"))
    told = lambda df: sorted(str((r.id, r.name, r.first)) for r in df.collect())
    assert told(read_buckets(spark, path)) == told(want) == told(store.load(spark, path))
    # Again, and one that comes too late: nothing is written. A batch that was cut short writes the rest.
    for batch, again in ((8, two), (7, one)):
        assert upsert_buckets(again, path, ["id"], batch, 16, order) == []
    assert told(looked_up(spark, path, two.select("id"), ["id"])) == told(want.where("id IN (3, 4, 500)"))
    with pytest.raises(ValueError):
        upsert_buckets(two, path, ["id"], 9, 32)


def test_a_batch_that_was_cut_short_writes_the_rest(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(100).select("id", F.lit("a").alias("name"))
    half = df.where(bucket_of(["id"], 8) < 4)
    assert upsert_buckets(half, path, ["id"], 1, 8) == [0, 1, 2, 3]
    assert upsert_buckets(df, path, ["id"], 1, 8) == [4, 5, 6, 7]
    assert upsert_buckets(df, path, ["id"], 1, 8) == [] and read_buckets(spark, path).count() == 100


def test_changes_of_state_as_a_stream(spark, tmp_path):
    """Two batches; an event that comes late takes its place, and one that repeats a state is no change. A last batch moves the watermark on."""
    at = lambda n: T0 + dt.timedelta(minutes=n)
    kinds = "job string, item long, status string, ts timestamp"
    batches = [[("j", 1, "queued", at(1)), ("j", 1, "processing", at(3)), ("j", 2, "queued", at(1)), ("k", 1, "queued", at(0))], [("j", 1, "completed", at(5)), ("j", 1, "queued", at(2)), ("j", 2, "queued", at(4)), ("k", 1, "failed", at(2)), ("k", 1, None, at(1))], [("end", 1, "queued", at(500))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = work.work_stream(spark, f"file://{tmp_path}/in/*", spark.createDataFrame(rows, kinds).schema)
        changes = work.status_changes(stream, "job", "item", "status")
        changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.parquet(f"{tmp_path}/out")
    told = {(r.item, r.from_status, r.to_status) for r in landed.where("job = 'j'").collect()}
    assert told == {(1, None, "queued"), (1, "queued", "processing"), (1, "processing", "completed"), (2, None, "queued")} and landed.count() == 6
    events = spark.createDataFrame(sum(batches[:2], []), kinds)
    want = {tuple(r) for r in work.running_status(events, "job", "item", "status").collect()}
    assert {tuple(r) for r in work.status_counts(landed, "job").collect()} == want == {("j", 2, 1, 0, 1, 0), ("k", 1, 0, 0, 0, 1)}


def test_stream_and_table_give_the_same_changes(spark, tmp_path):
    """Random events with equal times, ties, late rows and finished items that begin anew; the state of finished items goes."""
    rng = random.Random(1)
    kinds = "job string, item long, status string, ts timestamp, n long"
    now, batches, n = 0.0, [], 0
    for _ in range(7):
        rows = []
        for _ in range(60):
            now += rng.choice([0, 0, 1, 2])
            n += 1
            rows.append((rng.choice(["hot", "hot", "b"]), rng.randrange(6), rng.choice([*schemas.QUEUE_STATES, "completed", None]), T0 + dt.timedelta(minutes=now - rng.randrange(25)), rng.choice([n, None])))
        batches.append(rows)
    events = spark.createDataFrame(sum(batches, []), kinds)
    batches.append([("end", 0, "queued", T0 + dt.timedelta(days=9), 0)])
    more = {"tie": ["n"], "keep": "10 minutes"}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        changes = work.status_changes(work.work_stream(spark, f"file://{tmp_path}/in/*", events.schema), "job", "item", "status", late="30 minutes", parts=3, **more)
        query = changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    want = work.status_changes(events, "job", "item", "status", **more)
    assert told(spark.read.parquet(f"{tmp_path}/out")) == told(want)
    anew = want.where("from_status IS NULL").count()
    assert anew > events.select("job", "item").distinct().count()  # some were forgotten
    stored = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "last").load()
    # Only items that never finished are still held, and none waits but the closing event.
    left = work.latest(events.where("status IS NOT NULL"), ["job", "item"], F.desc("ts"), F.desc("n"), F.desc("status")).where(~F.col("status").isin(*work.FINISHED)).count()
    assert stored.count() == left


def test_rank_in_ranges(spark):
    """Equals one sort for each group: nulls, NaN, ties, a null group, small and large groups."""
    rows = [(g, None if n % 17 == 0 else float("nan") if n % 19 == 0 else float(n * 7 % 23), n) for g, m in (("a", 300), (None, 200), ("b", 5)) for n in range(m)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    want = {tuple(r) for r in ranking.ranked(df, "g", "s", "id").select("g", "id", "rank").collect()}
    assert {tuple(r) for r in ranking.ranked_in_ranges(df, "g", "s", "id", hot_rows=50, ranges=8).select("g", "id", "rank").collect()} == want
    assert ranking.ranked_in_ranges(df.limit(0), "g", "s", "id").count() == 0


def test_schemas(spark):
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).schema == schemas.schema(name)


def test_stored_tables(spark, tables, tmp_path):
    from rankloom.sources import tables as stored

    root = f"file://{tmp_path}"
    store.save(tables["jobs"].drop("location", "max_experience_years"), f"{root}/jobs")
    jobs = stored.table(spark, root, "jobs")
    assert jobs.schema == schemas.schema("jobs") and stored.row(jobs, "j1").title == "One"
    with pytest.raises(KeyError):
        stored.row(jobs, "none")
    models = made(spark, "models", id=["mock_a", "mockXb", "q"], size_bytes=[3, 2, 1], is_active=[False, True, True], file_path=[None, None, "/q"])
    assert [r.id for r in stored.models_by_size(models).collect()] == ["q", "mockXb", "mock_a"]
    assert [r.id for r in stored.active_model(models).collect()] == ["q"]
    assert stored.models_like(models, "MOCK_%").count() == 2
    assert [r.id for r in stored.active_model(store.single_active(models, "mockXb")).collect()] == []
    assert stored.candidates_by_email(tables["candidates"], " ANN@x.org").count() == 1
    assert stored.of_job(tables["resumes"], "j1").count() == 2 and stored.raw_text(tables["resumes"], "r1") is None
    events = stored.pipeline_events(tables["processing_queue"], store.reconciled(tables["processing_queue"])).collect()
    assert [(e.item_id, e.from_status, e.event) for e in events] == [("q1", "processing", "queued")]
