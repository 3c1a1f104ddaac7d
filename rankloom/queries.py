"""Registered queries over the driver's tables, each with its SQL.

The driver's tables stand in for the screening tables: customers for jobs, orders for
résumés, labels for shortlists, events for the work queue, conversations for pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import json_repair, scoring, text, vectors
from rankloom.functions.embedding import embedding
from rankloom.functions.layout import BULLET, BULLETS, NOW_WORDS, RANGE_MARKS, SHOWN, STORED, Layout, combined_pages, normalized
from rankloom.operators import ranking, store, views
from rankloom.operators.lines import rebuilt_texts
from rankloom.operators.topk import similar_pruned
from rankloom.session import spread
from rankloom.streaming import work

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Stand-ins.


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "archived").otherwise("active").alias("status"), F.col("c_acctbal").alias("updated_at"))


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "analyzing").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 500).alias("candidate_id"), status.alias("status"), F.concat(F.lit("file "), "o_orderkey").alias("file_name"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("uploaded_at"), F.col("o_totalprice").alias("price"))


def shortlists(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    state = F.when(F.col("o_totalprice") > 200000, "shortlisted").when(F.col("o_totalprice") < 50000, "rejected").otherwise("pending")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("candidate_id"), state.alias("status"), F.col("o_orderpriority").alias("notes"))


JOBS_SQL = "SELECT c_custkey AS id, c_name AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN 'archived' ELSE 'active' END AS status, c_acctbal AS updated_at FROM customer"
RESUMES_SQL = "SELECT o_orderkey AS id, o_custkey AS job_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 500 END AS candidate_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'analyzing' ELSE 'completed' END AS status, concat('file ', o_orderkey) AS file_name, o_orderdate AS uploaded_at, o_totalprice AS price FROM orders"
SHORTLISTS_SQL = "SELECT o_custkey AS job_id, o_orderkey AS candidate_id, CASE WHEN o_totalprice > 200000 THEN 'shortlisted' WHEN o_totalprice < 50000 THEN 'rejected' ELSE 'pending' END AS status, o_orderpriority AS notes FROM orders"
WITH = f"WITH jobs AS ({JOBS_SQL}), resumes AS ({RESUMES_SQL}), shortlists AS ({SHORTLISTS_SQL})"
SUMMARY_SQL = f"""{WITH} SELECT j.*, (SELECT count(*) FROM resumes r WHERE r.job_id = j.id) AS candidate_count,
(SELECT count(*) FROM shortlists s WHERE s.job_id = j.id AND s.status = 'shortlisted') AS shortlisted_count,
(SELECT count(*) FROM resumes r WHERE r.job_id = j.id AND r.status IN ('pending', 'queued', 'extracting', 'analyzing')) AS processing_count
FROM jobs j WHERE j.status <> 'archived'"""


@query(SUMMARY_SQL)
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    for name, f in (("jobs", jobs), ("resumes", resumes), ("shortlists", shortlists)):
        f(spark, sf).createOrReplaceTempView(f"rankloom_{name}")
    return spark.sql(views.job_summary_sql("rankloom_jobs", "rankloom_resumes", "rankloom_shortlists"))


@query(SUMMARY_SQL)
def job_summary_agg(spark: SparkSession, sf: str) -> DataFrame:
    return views.job_summary(jobs(spark, sf), resumes(spark, sf), shortlists(spark, sf))


@query(f"SELECT count(*) AS active_jobs, CAST(sum(candidate_count) AS BIGINT) AS candidates, CAST(sum(shortlisted_count) AS BIGINT) AS shortlisteds, CAST(sum(processing_count) AS BIGINT) AS processings FROM ({SUMMARY_SQL})")
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    return views.dashboard_totals(job_summary_agg(spark, sf))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("other")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_id").alias("resume_id"), F.col("value").alias("priority"), state.alias("status"), F.col("ts").alias("queued_at"))


QUEUE_SQL = "SELECT event_id AS id, user_id AS job_id, value AS priority, ts AS queued_at, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END AS status FROM events"


@query(f"""SELECT *, CAST(greatest(0, least(100, round((completed + failed) * 100.0 / total))) AS INTEGER) AS percent, CASE WHEN in_progress + queued > 0 THEN (total - completed - failed) * 8 END AS seconds_left FROM (
SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS in_progress, count(*) FILTER (status = 'queued') AS queued FROM ({QUEUE_SQL}) GROUP BY job_id)""")
def processing_status(spark: SparkSession, sf: str) -> DataFrame:
    return views.progress(views.processing_status(queue(spark, sf)))


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS in_progress, count(*) FILTER (status = 'queued') AS queued FROM ({QUEUE_SQL}) WHERE job_id = -1")
def processing_status_empty(spark: SparkSession, sf: str) -> DataFrame:
    return views.processing_status(queue(spark, sf), -1)


@query(f"SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY priority DESC NULLS LAST, queued_at, id) AS position FROM ({QUEUE_SQL}) WHERE status = 'queued'")
def queue_order(spark: SparkSession, sf: str) -> DataFrame:
    return views.queue_order(queue(spark, sf), within="job_id").select("job_id", "id", "position")


@query(f"SELECT id, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS status FROM ({QUEUE_SQL})")
def queue_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return store.reconciled(queue(spark, sf)).select("id", "status")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"), F.lit(None).cast("string").alias("phone"), F.col("c_mktsegment").alias("location"))


CANDIDATES_SQL = "SELECT c_custkey AS id, c_name AS name, concat(lower(replace(c_name, '#', '.')), '@example.com') AS email, c_mktsegment AS location FROM customer"


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    base = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    nested = {"extracted_skills": "array<string>", "matched_skills": "array<string>", "missing_skills": "array<string>", "education": "array<string>", "previous_roles": "array<string>", "strengths": "array<string>", "concerns": "array<string>"}
    plain = ["skills_score", "experience_score", "semantic_score", "llm_score", "rank", "experience_years", "ai_summary"]
    return base.select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("resume_id"), F.col("o_custkey").alias("job_id"), (F.col("q") * 2).alias("overall_score"), *(F.lit(None).cast("double").alias(n) for n in plain), *(F.lit(None).cast(t).alias(n) for n, t in nested.items()))


ANALYSES_SQL = "SELECT l_orderkey AS id, l_orderkey AS resume_id, o_custkey AS job_id, max(l_quantity) * 2 AS overall_score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
LISTING_SQL = f"""{WITH}, candidates AS ({CANDIDATES_SQL}), analyses AS ({ANALYSES_SQL}),
listing AS (SELECT coalesce(c.id, r.id) AS id, r.id AS resume_id, r.job_id, coalesce(c.name, r.file_name) AS name, c.email, r.status, r.uploaded_at, coalesce(s.status, 'pending') AS shortlist_status, s.notes, a.overall_score
FROM resumes r LEFT JOIN candidates c ON r.candidate_id = c.id LEFT JOIN analyses a ON a.resume_id = r.id AND a.job_id = r.job_id
LEFT JOIN shortlists s ON s.job_id = r.job_id AND (s.candidate_id = c.id OR s.candidate_id = r.id))"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return views.candidate_listing(resumes(spark, sf), candidates(spark, sf), analyses(spark, sf), shortlists(spark, sf))


@query(f"{LISTING_SQL} SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN overall_score IS NULL THEN 1 ELSE 0 END, overall_score DESC NULLS LAST, uploaded_at DESC NULLS LAST, resume_id, notes) AS position FROM listing")
def candidate_listing(spark: SparkSession, sf: str) -> DataFrame:
    placed = views.numbered(listing(spark, sf), "job_id", *views.listing_order(), F.asc_nulls_last("notes"), F.asc("shortlist_status"))
    return placed.select("id", "resume_id", "job_id", "name", "email", "status", "uploaded_at", "shortlist_status", "notes", F.col("analysis.overall_score").alias("overall_score"), "position")


@query(f"{LISTING_SQL} SELECT resume_id, name FROM listing WHERE (contains(lower(name), '00000001') OR coalesce(contains(lower(email), '00000001'), false)) AND shortlist_status = 'pending'")
def candidate_search_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.searched(listing(spark, sf), "00000001", "pending").select("resume_id", "name")


@query(f"{WITH} SELECT job_id, id, uploaded_at FROM resumes QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY uploaded_at DESC NULLS LAST, id) = 1")
def candidate_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.latest(resumes(spark, sf), ["job_id"], F.desc_nulls_last("uploaded_at"), F.asc("id")).select("job_id", "id", "uploaded_at")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(m), 'scanned|no extractable text|text layer') THEN 'scanned' WHEN m IS NOT NULL THEN 'other' END AS error_class FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('PDF is SCANNED: ', source) WHEN 1 THEN concat('no text layer in ', source) WHEN 2 THEN source END AS m FROM documents)")
def error_class(spark: SparkSession, sf: str) -> DataFrame:
    m = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("PDF is SCANNED: "), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("no text layer in "), "source")).when(F.col("doc_id") % 4 == 2, F.col("source"))
    return read(spark, sf, "documents").select("doc_id", text.error_class(m).alias("error_class"))


@query("SELECT o_custkey AS job_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders")
def rank_in_job(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(resumes(spark, sf), "job_id", "price", "id").select("job_id", "id", "rank")


SKILL_SQL = """WITH p AS (SELECT p_partkey, [struct_pack(s := split_part(p_name, ' ', 1), m := true), struct_pack(s := ' ' || upper(p_brand), m := false), struct_pack(s := 'nothing like it', m := p_partkey % 2 = 0)] AS r,
  [lower(trim(x)) FOR x IN CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [split_part(p_name, ' ', 1), 'z'] ELSE [lower(p_brand), 'y'] END] AS c FROM part),
g AS (SELECT p_partkey, [struct_pack(s := x.s, m := x.m, e := list_contains(c, lower(trim(x.s))), q := len([1 FOR k IN c IF contains(k, lower(trim(x.s))) OR contains(lower(trim(x.s)), k)]) > 0) FOR x IN r] AS r FROM p)
SELECT p_partkey, round(100.0 * (list_sum([CASE WHEN x.m THEN CASE WHEN x.e THEN 1.0 WHEN x.q THEN 0.6 ELSE 0.0 END ELSE CASE WHEN x.e OR x.q THEN 0.5 ELSE 0.0 END END FOR x IN r]) / list_sum([CASE WHEN x.m THEN 1.0 ELSE 0.5 END FOR x IN r]))::DOUBLE, 4) AS score,
array_to_string([x.s FOR x IN r IF x.e OR x.q], '|') AS matched, array_to_string([x.s FOR x IN r IF NOT (x.e OR x.q)], '|') AS missing FROM g"""


@query(SKILL_SQL)
def skill_match(spark: SparkSession, sf: str) -> DataFrame:
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    skill = lambda s, m: F.struct(s.alias("skill"), F.when(m, "required").otherwise("nice-to-have").alias("importance"))
    wanted = F.array(skill(first, F.lit(True)), skill(F.concat(F.lit(" "), F.upper("p_brand")), F.lit(False)), skill(F.lit("nothing like it"), F.col("p_partkey") % 2 == 0))
    have = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).when(F.col("p_partkey") % 3 == 1, F.array(first, F.lit("z"))).otherwise(F.array(F.lower("p_brand"), F.lit("y")))
    found = read(spark, sf, "part").select("p_partkey", scoring.match_skills(wanted, have).alias("m"))
    names = lambda c: F.array_join(F.transform(F.col(c), lambda s: s["skill"]), "|")
    return found.select("p_partkey", F.round("m.score", 4).alias("score"), names("m.matched").alias("matched"), names("m.missing").alias("missing"))


BANDS = [(2.0, 4.0), (3.0, None), (None, 20.0), (0.0, 0.0), (10.0, 5.0)]
BANDS_SQL = "(VALUES (0, 2.0::DOUBLE, 4.0::DOUBLE), (1, 3.0, NULL), (2, NULL, 20.0), (3, 0.0, 0.0), (4, 10.0, 5.0)) b(band, lo0, hi0)"


@query(f"""SELECT p_partkey, band, round(CASE WHEN lo <= 0 AND hi <= 0 THEN 100.0 WHEN y IS NULL OR y < 0 THEN 50.0
WHEN lo > 0 AND hi > 0 AND hi >= lo THEN CASE WHEN y BETWEEN lo AND hi THEN 100.0 WHEN y < lo THEN least(75.0, y / lo * 75.0) ELSE greatest(85.0, 100.0 - least((y - hi) * 2, 10.0)) END
WHEN lo > 0 THEN CASE WHEN y >= lo THEN least(least(y / lo, 1.5) * 90, 100.0) ELSE y / lo * 70 END
ELSE CASE WHEN y <= hi THEN 100.0 ELSE greatest(100.0 - least(y - hi, 5.0) * 6, 60.0) END END::DOUBLE, 6) AS score FROM (
SELECT p_partkey, band, CASE WHEN p_partkey % 10 > 0 THEN p_size::DOUBLE - 2 END AS y, greatest(coalesce(lo0, 0), 0)::DOUBLE AS lo, greatest(coalesce(hi0, 0), 0)::DOUBLE AS hi FROM part, {BANDS_SQL})""")
def experience_match(spark: SparkSession, sf: str) -> DataFrame:
    years = F.when(F.col("p_partkey") % 10 > 0, F.col("p_size").cast("double") - 2)
    number = lambda x: F.lit(x).cast("double")
    bands = F.array(*(F.struct(F.lit(i).alias("band"), number(lo).alias("lo"), number(hi).alias("hi")) for i, (lo, hi) in enumerate(BANDS)))
    rows = read(spark, sf, "part").select("p_partkey", years.alias("y"), F.inline(bands))
    return rows.select("p_partkey", "band", F.round(scoring.match_experience(F.col("lo"), F.col("hi"), F.col("y")), 6).alias("score"))


PARTS_SQL = "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS s, l_discount * 1000 AS e, 100 - l_tax * 1000 AS m FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, round(s * 0.40 + e * 0.25 + m * 0.20 + l * 0.15, 1) AS overall, round(l, 1) AS llm, CASE WHEN round(s * 0.40 + e * 0.25 + m * 0.20 + l * 0.15, 1) >= 75 THEN 'high' WHEN round(s * 0.40 + e * 0.25 + m * 0.20 + l * 0.15, 1) >= 50 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, greatest(10.0, least(98.0, greatest(0.0, least(100.0, s * 0.6 + e * 0.4)) * 0.7 + 25.0))::DOUBLE AS l FROM (SELECT l_orderkey, l_linenumber, s::DOUBLE s, e::DOUBLE e, m::DOUBLE m FROM ({PARTS_SQL})))""")
def final_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("s"), (F.col("l_discount") * 1000).alias("e"), (100 - F.col("l_tax") * 1000).alias("m"))
    llm = scoring.llm_fallback_score(scoring.deterministic_score(F.col("s"), F.col("e")))
    total = rows.select("l_orderkey", "l_linenumber", scoring.final_score(F.col("s"), F.col("e"), F.col("m"), llm).alias("t"))
    return total.select("l_orderkey", "l_linenumber", F.col("t.overall").alias("overall"), F.col("t.llm").alias("llm"), scoring.score_band(F.col("t.overall")).alias("band"))


VECTOR_SQL = "v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)"
COSINE = "list_sum([x[1] * x[2] FOR x IN list_zip(a.e, b.e)]) / (sqrt(list_sum([x * x FOR x IN a.e])) * sqrt(list_sum([x * x FOR x IN b.e])))"


@query(f"""WITH {VECTOR_SQL}, p AS (SELECT b.vec_id, {COSINE} AS c FROM v a, v b WHERE a.vec_id = (SELECT min(vec_id) FROM v))
SELECT vec_id, round(c, 6) AS cosine, CASE WHEN c >= 0 THEN round(50 + pow(least(c / 0.65, 1), 0.8) * 50, 1) ELSE round((c + 1) / 2 * 50, 1) END AS score FROM p""")
def semantic_score(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings")
    first = v.agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = v.join(F.broadcast(first)).select("vec_id", vectors.cosine_similarity(F.col("q"), F.col("embedding")).alias("c"))
    return scored.select("vec_id", F.round("c", 6).alias("cosine"), vectors.semantic_score(F.col("c")).alias("score"))


@query(f"""WITH {VECTOR_SQL} SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank
FROM v a, v b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = ranking.similar_for_each(v, asked, 5, "vec_id", "embedding")
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(SQL["vector_topk"])
def vector_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """As ``vector_topk``, by clusters whose bounds are met."""
    v = read(spark, sf, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found, _ = similar_pruned(v, asked, 5, "vec_id", "embedding")
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {VECTOR_SQL}, w AS (SELECT vec_id, e, sqrt(list_sum([y * y FOR y IN e])) AS n FROM v UNION ALL SELECT -1, NULL, NULL UNION ALL SELECT -2, [0.0, 0.0], 0)
SELECT vec_id, array_to_string([CAST(CAST(round(CAST(CAST(CASE WHEN n > 1e-12 THEN x / n ELSE x END AS FLOAT) AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR) FOR x IN e], ',') AS unit FROM w""")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    odd = spark.sql("SELECT -1L AS vec_id, CAST(NULL AS ARRAY<FLOAT>) AS embedding UNION ALL SELECT -2L, CAST(array(0, 0) AS ARRAY<FLOAT>)")
    unit = vectors.normalize_l2(F.col("embedding"))
    written = F.transform(unit, lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string"))
    return read(spark, sf, "embeddings").select("vec_id", "embedding").unionByName(odd).select("vec_id", F.array_join(written, ",").alias("unit"))


TEXT_SQL = "SELECT doc_id, text FROM documents UNION ALL SELECT 1000000 + p_partkey, concat(p_name, ' ', p_size, '+ years of experience; 4', p_partkey % 3, '.5 yrs') FROM part"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("doc_id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit("+ years of experience; 4"), F.col("p_partkey") % 3, F.lit(".5 yrs")).alias("text"))
    return read(spark, sf, "documents").select("doc_id", "text").unionByName(p)


@query(rf"""SELECT doc_id, nullif(regexp_extract(text, '{text.EMAIL}', 0), '') AS email, nullif(regexp_extract(text, '{text.PHONE}', 0), '') AS phone, CASE WHEN y > 0 AND y < 40 THEN y END AS years FROM (SELECT *, TRY_CAST(nullif(regexp_extract(text, '{text.YEARS}', 1), '') AS DOUBLE) AS y FROM ({TEXT_SQL}))""")
def email_phone_years(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf).select("doc_id", text.email(t).alias("email"), text.phone(t).alias("phone"), text.experience_years(t).alias("years"))


@query(r"""WITH l AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(coalesce(text, ''), chr(10))] IF x <> ''] AS l FROM documents)
SELECT doc_id, coalesce([x FOR x IN l IF NOT contains(x, '@') AND NOT contains(x, 'http') AND NOT contains(x, '.com') AND octet_length(encode(x)) < 50 AND len(string_split_regex(x, '\s+')) BETWEEN 2 AND 4][1], l[1], 'Candidate') AS name FROM l""")
def name_line(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", text.name_line(F.coalesce("text", F.lit(""))).alias("name"))


STOCK = ("Rust and asp.net with CI/CD, Java", "javascript, REST API; go.", "C++ or C#, C++x", "Machine  Learning / machine learning", "node.js GIT numpy")


def _skill_text(key: str, name: str) -> F.Column:
    return F.concat_ws(" ", F.col(name), F.element_at(F.array(*(F.lit(s) for s in STOCK)), (F.col(key) % len(STOCK) + 1).cast("int")))


STOCK_SQL = "[" + ", ".join(f"'{s}'" for s in STOCK) + "]"
DICTIONARY_SQL = "SELECT p_partkey, array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '|') AS skills FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, {}[p_partkey % 5 + 1])) AS t FROM part)".format(", ".join(rf"CASE WHEN regexp_matches(t, '\b{text._quoted(s)}\b') THEN '{s}' END" for s in text.SKILL_CATALOG), STOCK_SQL)


@query(DICTIONARY_SQL)
def skills_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.array_join(text.skills(_skill_text("p_partkey", "p_name")), "|").alias("skills"))


@query(r"""WITH t AS (SELECT 0 AS kind, doc_id AS id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents UNION ALL SELECT 1, conv_id * 100 + turn, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM conversations UNION ALL SELECT 2, p_partkey, concat(p_name, ' ', p_type, ' ', p_size, repeat(' 12', p_size)) FROM part),
c AS (SELECT kind, id, length(t)::INTEGER AS chars, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END::INTEGER AS words, length(regexp_replace(t, '[^\p{L}\p{Nl}]+', '', 'g')) AS letters FROM t)
SELECT kind, id, words AS word_count, chars AS char_count, NOT (chars = 0 OR words < 10 OR chars < 30 OR letters < 15) AS is_usable, CASE WHEN chars = 0 THEN 'Extracted text is empty' WHEN words < 10 THEN concat('Insufficient word count (', words, ' < 10)') WHEN chars < 30 THEN concat('Insufficient character count (', chars, ' < 30)') WHEN letters < 15 THEN concat('Insufficient alphabetic character count (', letters, ' < 15)') ELSE 'Text layer meets quality criteria' END AS reason FROM c""")
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = read(spark, sf, "conversations").select(F.lit(1).alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    parts = read(spark, sf, "part").select(F.lit(2).alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", F.concat("p_size", F.repeat(F.lit(" 12"), F.col("p_size")))).alias("text"))
    q = docs.unionByName(turns).unionByName(parts).select("kind", "id", text.page_quality(F.col("text")).alias("q"))
    return q.select("kind", "id", "q.word_count", "q.char_count", "q.is_usable", "q.reason")


@query(r"""WITH p AS (SELECT conv_id, turn * 2 + k AS page, trim(coalesce(text, '')) AS t FROM conversations, (VALUES (0), (1)) d(k) WHERE k = 0 OR turn % 3 = 0),
k AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY page) AS b FROM p WHERE t <> '')
SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS text FROM k WHERE t IS DISTINCT FROM b GROUP BY conv_id""")
def page_combine(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("k = 0 OR turn % 3 = 0")
    return combined_pages(turns.withColumn("page", F.col("turn") * 2 + F.col("k")), "conv_id", "page", "text", layout=None)


@query("""WITH f AS (SELECT lang AS job_id, source AS file_name, n_chars AS file_size, doc_id FROM documents)
SELECT doc_id, m IS NOT NULL AS is_duplicate, m AS existing_resume_id FROM f LEFT JOIN (SELECT job_id, file_name, file_size, min(doc_id) AS m FROM f WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL) USING (job_id, file_name, file_size)""")
def duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    f = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("job_id"), F.col("source").alias("file_name"), F.col("n_chars").alias("file_size"))
    known = f.join(read(spark, sf, "labels"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id").withColumns({"uploaded_at": F.lit(None).cast("timestamp"), "status": F.lit("completed")})
    return views.duplicate_check(f, known).select("doc_id", "is_duplicate", "existing_resume_id")


@query("SELECT max(doc_id) AS doc_id, sha256(coalesce(text, '')) AS h FROM documents GROUP BY coalesce(text, '')")
def text_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest_by_text(read(spark, sf, "documents"), "text", F.desc("doc_id")).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey % 700 AS c, (o_orderkey % 2) * 1000000000000 + o_orderkey AS z FROM orders), e AS (SELECT *, CASE WHEN c % 7 = 0 THEN concat('id:', k) ELSE concat('mail:c', c, '@x.org') END AS key, concat('n', k) AS name, CASE WHEN k % 3 = 0 THEN concat('p', k) END AS phone FROM a)
SELECT CAST(arg_min(k, z) AS VARCHAR) AS id, arg_max(name, z) AS name, arg_max(phone, z) FILTER (phone IS NOT NULL) AS phone FROM e GROUP BY key""")
def upsert_candidate(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("arrival"), (F.col("o_custkey") % 700).alias("c"))
    mail = F.when(F.col("c") % 7 > 0, F.when(F.col("arrival") % 2 == 0, F.concat(F.lit("C"), "c", F.lit("@x.org"))).otherwise(F.concat(F.lit("c"), "c", F.lit("@X.org"))))
    rows = o.select(F.col("arrival").cast("string").alias("id"), F.concat(F.lit("n"), "arrival").alias("name"), mail.alias("email"), F.when(F.col("arrival") % 3 == 0, F.concat(F.lit("p"), "arrival")).alias("phone"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("timestamp").alias("created_at"), "arrival")
    split = F.col("arrival") % 2 == 0
    old = rows.where(split)
    stored = store.upserted_candidates(rows.limit(0).drop("arrival"), old)
    return store.upserted_candidates(stored, rows.where(~split)).select("id", "name", "phone")


@query("""WITH o AS (SELECT o_custkey AS job_id, o_orderkey % 50 AS candidate_id, o_orderkey AS z, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS notes, o_orderkey % 3 = 0 AS fresh FROM orders),
a AS (SELECT job_id, candidate_id, arg_max(status, z) AS status, arg_max(struct_pack(n := notes), z).n AS notes FROM o WHERE NOT fresh GROUP BY ALL), b AS (SELECT job_id, candidate_id, arg_max(status, z) AS status, arg_max(struct_pack(n := notes), z).n AS notes FROM o WHERE fresh GROUP BY ALL)
SELECT job_id, candidate_id, coalesce(b.status, a.status) AS status, coalesce(b.notes, a.notes) AS notes FROM a FULL JOIN b USING (job_id, candidate_id)""")
def upsert_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 50).alias("candidate_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("notes"))
    key = ["job_id", "candidate_id"]
    stored = ranking.latest(o.where("at % 3 > 0"), key, F.desc("at")).drop("at")
    return store.upserted(stored, o.where("at % 3 = 0"), key, keep=(), fill=("notes",), order="at")


@query("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, concat('n', c_custkey) AS name, concat('c', c_custkey % 300, '@x.org') AS email, CASE WHEN c_custkey % 2 = 0 THEN concat('p', c_custkey) END AS phone FROM customer),
a AS (SELECT o_orderkey AS z, concat('o', o_orderkey) AS id, concat('m', o_orderkey) AS name, CASE WHEN o_custkey % 5 > 0 THEN concat('c', o_custkey % 400, '@x.org') END AS email, CASE WHEN o_orderkey % 3 = 0 THEN concat('q', o_orderkey) END AS phone FROM orders WHERE o_orderkey % 4 = 0),
f AS (SELECT coalesce(email, id) AS k, arg_min(id, z) AS id, arg_max(name, z) AS name, arg_max(phone, z) FILTER (phone IS NOT NULL) AS phone FROM a GROUP BY coalesce(email, id)),
p AS (SELECT f.*, held FROM f LEFT JOIN (SELECT email AS k, min(id) AS held FROM s GROUP BY email) USING (k))
SELECT s.id, coalesce(p.name, s.name) AS name, coalesce(p.phone, s.phone) AS phone FROM s LEFT JOIN p ON p.held = s.id UNION ALL SELECT id, name, phone FROM p WHERE held IS NULL""")
def upsert_candidate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Stored candidates that share an e-mail: one of them is updated, none goes."""
    none = [F.lit(None).cast("string").alias("location"), F.lit(None).cast("timestamp").alias("created_at")]
    k = F.col("c_custkey")
    stored = read(spark, sf, "customer").select(k.cast("string").alias("id"), F.concat(F.lit("n"), k).alias("name"), F.concat(F.when(k % 2 == 0, "C").otherwise("c"), k % 300, F.lit("@x.org")).alias("email"), F.when(k % 2 == 0, F.concat(F.lit("p"), k)).alias("phone"), *none)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf, "orders").where(o % 4 == 0).select(F.concat(F.lit("o"), o).alias("id"), F.concat(F.lit("m"), o).alias("name"), F.when(c % 5 > 0, F.concat(F.lit(" c"), c % 400, F.lit("@X.org "))).alias("email"), F.when(o % 3 == 0, F.concat(F.lit("q"), o)).alias("phone"), *none, o.alias("arrival"))
    return store.upserted_candidates(stored, rows).select("id", "name", "phone")


@query(f"""{WITH}, gone AS (SELECT id AS job_id FROM jobs WHERE status = 'archived'), kept AS (SELECT * FROM resumes WHERE job_id NOT IN (SELECT job_id FROM gone)),
lost AS (SELECT DISTINCT candidate_id AS id FROM resumes WHERE job_id IN (SELECT job_id FROM gone) AND candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT candidate_id FROM kept WHERE candidate_id IS NOT NULL))
SELECT 'resumes' AS name, id FROM kept UNION ALL SELECT 'jobs', id FROM jobs WHERE status <> 'archived' UNION ALL SELECT 'candidates', id FROM ({CANDIDATES_SQL}) WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'shortlists', candidate_id FROM shortlists WHERE job_id NOT IN (SELECT job_id FROM gone) AND candidate_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'processing_queue', id FROM kept WHERE id % 2 = 0 UNION ALL SELECT 'embeddings', id FROM kept WHERE id % 5 = 0 UNION ALL SELECT 'candidate_analysis', id FROM kept WHERE id % 3 = 0""")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    r = resumes(spark, sf).withColumn("file_path", F.col("file_name"))
    hung = {n: r.where(F.col("id") % m == 0).select(F.col("id").alias("resume_id"), "job_id") for n, m in (("processing_queue", 2), ("embeddings", 5), ("candidate_analysis", 3))}
    tables = {"jobs": jobs(spark, sf), "resumes": r, "candidates": candidates(spark, sf), "shortlists": shortlists(spark, sf), **hung}
    out, _ = store.deleted_jobs(tables, tables["jobs"].where("status = 'archived'").select(F.col("id").alias("job_id")))
    key = {"jobs": "id", "resumes": "id", "candidates": "id", "shortlists": "candidate_id"}
    rows = [out[n].select(F.lit(n).alias("name"), F.col(key.get(n, "resume_id")).alias("id")) for n in tables]
    return reduce(DataFrame.unionByName, rows)


@query(f"{WITH} SELECT id, CASE WHEN id % 7 = 0 THEN concat('text ', id) ELSE file_name END AS raw_text, CASE WHEN id % 5 = 0 THEN id % 11 ELSE candidate_id END AS candidate_id FROM resumes")
def resume_texts_and_links(spark: SparkSession, sf: str) -> DataFrame:
    r = resumes(spark, sf).withColumn("raw_text", F.col("file_name"))
    read_now = r.where("id % 7 = 0").select("id", F.concat(F.lit("text "), "id").alias("raw_text"))
    linked = r.where("id % 5 = 0").select("id", (F.col("id") % 11).alias("candidate_id"))
    return store.resume_candidates(store.resume_texts(r, read_now), linked).select("id", "raw_text", "candidate_id")


@query("""WITH e AS (SELECT event_id AS id, event_id % 8 AS k FROM events) SELECT id, CASE k WHEN 0 THEN 25.0 WHEN 1 THEN 0.0 WHEN 2 THEN 100.0 WHEN 3 THEN 42.0 WHEN 4 THEN 70.5 WHEN 5 THEN id % 90 + 0.5 END AS llm_score,
CASE WHEN k < 6 THEN concat('said ', id) END AS summary, CASE WHEN k < 6 THEN CASE WHEN k = 2 THEN 'a|b' ELSE '' END END AS strengths FROM e""")
def analysis_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a model: quoted and plain scores, out of range, missing, without a summary, no JSON."""
    summary = F.concat(F.lit('"summary": " said '), "event_id", F.lit(' "'))
    scores = ['"llm_score": "-25", ', '"llm_score": -25, ', '"llm_score": 150, "strengths": [" a", "b ", " "], ', "", '"llm_score": "70.5 of 100", ']
    bodies = [F.concat(F.lit("{" + s), summary, F.lit(", }")) for s in scores]
    bodies += [F.concat(F.lit('Sure:\n```json\n{"llm_score": '), F.col("event_id") % 90 + 0.5, F.lit(", "), summary, F.lit("}\n```")), F.lit('{"llm_score": 5, "summary": " "}'), F.lit("no json")]
    raw = F.element_at(F.array(*bodies), (F.col("event_id") % 8 + 1).cast("int"))
    answers = read(spark, sf, "events").select(F.col("event_id").alias("id"), json_repair.analysis(raw, F.lit(42.0)).alias("a"))
    return answers.select("id", "a.llm_score", "a.summary", F.array_join("a.strengths", "|").alias("strengths"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' AND (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto'))")
def job_search(spark: SparkSession, sf: str) -> DataFrame:
    found = views.searched_jobs(jobs(spark, sf).join(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("location")), "id"), "AUTO", "active")
    named = views.searched_jobs(jobs(spark, sf).withColumn("location", F.lit(None).cast("string")), "7", "active")
    return found.select("id").unionByName(named.select("id")).distinct()


@query(f"{WITH} SELECT id FROM ({CANDIDATES_SQL}) c WHERE NOT EXISTS (SELECT 1 FROM resumes r WHERE r.candidate_id = c.id)")
def orphan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return store.orphan_candidates(candidates(spark, sf), resumes(spark, sf)).select("id")


@query("SELECT p_partkey, concat(upper(a), '|', b, CASE WHEN lower(p_brand) IN (lower(a), lower(b)) THEN '' ELSE '|' || p_brand END) AS skills FROM (SELECT *, split_part(p_name, ' ', 1) AS a, CASE WHEN split_part(p_name, ' ', 2) = split_part(p_name, ' ', 1) THEN 'same' ELSE split_part(p_name, ' ', 2) END AS b FROM part)")
def skill_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    b = F.when(a == b, "same").otherwise(b)
    return read(spark, sf, "part").select("p_partkey", F.array_join(text.skill_union(F.array(F.upper(a), b), F.array(a, F.upper(b), F.col("p_brand"), F.lower("p_brand"))), "|").alias("skills"))


@query("SELECT s_suppkey AS id, coalesce(string_agg(p_name, '|' ORDER BY l_partkey, p_name), '') AS skills FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def job_with_skills(spark: SparkSession, sf: str) -> DataFrame:
    used = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("pos"), F.col("p_name").alias("skill"), F.lit("required").alias("importance")).distinct()
    jobs_ = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return views.job_with_skills(jobs_, used, "pos").select("id", F.array_join(F.transform("skills", lambda s: s["skill"]), "|").alias("skills"))


JSON_SQL = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('Sure:', chr(10), '```json', chr(10), replace(props, '}', ', }'), chr(10), '```') WHEN 1 THEN concat('x ', replace(props, '}', ' , ' || chr(10) || '}'), ' y') WHEN 2 THEN 'no object' ELSE props END AS raw FROM events"


@query(rf"SELECT event_id, nullif(regexp_replace(regexp_replace(regexp_extract(raw, '(?s)\{{.*\}}', 0), ',\s*\}}', '}}', 'g'), ',\s*\]', ']', 'g'), '') AS repaired FROM ({JSON_SQL})")
def json_repaired(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    nl = F.lit("\n")
    raw = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), F.replace("props", F.lit("}"), F.lit(", }")), nl, F.lit("```"))).when(k == 1, F.concat(F.lit("x "), F.replace("props", F.lit("}"), F.lit(" , \n}")), F.lit(" y"))).when(k == 2, "no object").otherwise(F.col("props"))
    return read(spark, sf, "events").select("event_id", json_repair.json_object(raw).alias("repaired"))


@query("SELECT event_id, len(l)::BIGINT AS n, array_to_string(l, '|') AS listed FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', event_type] ELSE [] END AS l FROM events)")
def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.when(k == 0, json_repair.encoded_array(F.array(F.lit("a"), F.col("event_type")))).when(k == 1, "[broken")
    return read(spark, sf, "events").select("event_id", json_repair.decoded_array(raw, "array<string>").alias("l")).select("event_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("listed"))


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')), ' ') AS w FROM documents), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 512 THEN CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) ELSE 0 END AS last FROM w)
SELECT doc_id, k::INTEGER AS k, len(w[k * 448 + 1 : k * 448 + 512])::INTEGER AS words, md5(array_to_string(w[k * 448 + 1 : k * 448 + 512], ' ')) AS digest FROM (SELECT *, unnest(range(0, last + 1)) AS k FROM n)""")
def chunking(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r\f\x0b]+", " ")), " ")
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(text.chunks(words)).alias("k", "c"))
    return rows.select("doc_id", "k", F.size("c").alias("words"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query(r"WITH g AS (SELECT [w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM (SELECT [x FOR x IN string_split_regex(lower(p_name || ' of ' || p_brand), '[^a-z0-9+#.]+') IF x <> ''] AS w FROM part)) SELECT gram, count(*) AS n FROM (SELECT unnest(g) AS gram FROM g) GROUP BY gram")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = text.word_ngrams(F.concat_ws(" of ", "p_name", "p_brand"))
    return read(spark, sf, "part").select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN lo > 0 AND hi > 0 THEN CASE WHEN lo = hi THEN concat(lo, ' years') ELSE concat(lo, ' - ', hi, ' years') END WHEN lo > 0 THEN concat(lo, '+ years') WHEN hi > 0 THEN concat('Up to ', hi, ' years') ELSE 'Not specified' END AS label, substr(o_orderpriority, 1, 3) AS cut FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS hi FROM orders)")
def labels_and_cuts(spark: SparkSession, sf: str) -> DataFrame:
    low = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 5).cast("double"))
    high = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 7).cast("double"))
    return read(spark, sf, "orders").select("o_orderkey", text.experience_label(low, high).alias("label"), text.truncated(F.col("o_orderpriority"), 3).alias("cut"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return work.daily_counts(read(spark, sf, "events"))


@query("""WITH s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END AS st FROM events),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, count(*) AS total, count(*) FILTER (st = 'queued') AS queued, count(*) FILTER (st = 'processing') AS processing, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'failed') AS failed FROM l GROUP BY user_id""")
def running_status(spark: SparkSession, sf: str) -> DataFrame:
    e = queue(spark, sf).select(F.col("job_id").alias("user_id"), (F.col("id") % 7).alias("item"), "status", F.struct("queued_at", "id").alias("at"))
    return work.running_status(e, item="item", state="status", at="at")


@query("SELECT map_from_entries(list(struct_pack(k := key, v := value) ORDER BY key))::VARCHAR AS settings FROM (SELECT c_mktsegment AS key, max(c_name) AS value FROM customer GROUP BY 1)")
def settings_map(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"), F.lit(None).cast("timestamp").alias("updated_at"))
    entries = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return views.settings_map(c).select(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias("settings"))


@query()
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", embedding(F.col("text")).alias("embedding"))


_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_REACHED = "(coalesce(lag({0}) OVER o, 0) >= 2 OR coalesce(lag({0}, 2) OVER o, 0) = 3)"
_YEAR = "regexp_full_match({}, '(19|20)[0-9]{{2}}')"
def _normalize_sql(layout: Layout, docs: str = "documents") -> str:
    """The layout rebuilding over token rows: kinds, runs, parts of runs, lines cut one after another, blank lines once."""
    core = "CASE WHEN starts_with(token, '(') AND ends_with(token, ')') THEN token[2:] ELSE token END" if layout.wide_numbers else "token"
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS r, [x FOR x IN string_split_regex(coalesce(text, ''), '\s+') IF x <> ''] AS w FROM {docs}),
a AS (SELECT *, regexp_matches(token, '\p{{L}}') AND NOT regexp_matches(token, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') AS c FROM (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS token FROM t)),
b AS (SELECT *, coalesce(lead(token) OVER o, '') AS after, coalesce(lead(token, 2) OVER o, '') AS t2, coalesce(lead(c) OVER o, false) AS c1, coalesce(lead(c, 2) OVER o, false) AS c2 FROM a WINDOW o AS (PARTITION BY r ORDER BY p)),
s0 AS (SELECT *, CASE WHEN c AND c1 AND c2 AND token || ' ' || after || ' ' || t2 IN ({_LIST(layout.wide)}) THEN 3 WHEN c AND c1 AND token || ' ' || after IN ({_LIST(layout.wide)}) THEN 2 ELSE 0 END AS wide FROM b),
s1 AS (SELECT *, CASE WHEN {_REACHED.format("wide")} THEN 0 ELSE wide END AS z1 FROM s0 WINDOW o AS (PARTITION BY r ORDER BY p)),
s2 AS (SELECT *, CASE WHEN {_REACHED.format("z1")} THEN 0 ELSE wide END AS z FROM s1 WINDOW o AS (PARTITION BY r ORDER BY p)),
e AS (SELECT r, p, after, CASE WHEN z > 0 OR c AND upper(token) IN ({_LIST(layout.single)}) AND after NOT IN ('&', 'and') AND NOT ends_with(after, ':') THEN 'header' WHEN length(token) = 1 AND contains('{BULLETS}', token) OR regexp_full_match({core}, '[0-9]{{1,2}}[.)]') THEN 'bullet' ELSE 'word' END AS kind,
 CASE z WHEN 3 THEN upper(token || ' ' || after || ' ' || t2) WHEN 2 THEN upper(token || ' ' || after) ELSE token END AS token FROM (SELECT *, {_REACHED.format("z")} AS inside FROM s2 WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE NOT inside),
f AS (SELECT *, sum(change) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT *, lag(kind) OVER o AS before, lead(kind) OVER o AS follows, (kind <> coalesce(lag(kind) OVER o, kind))::INTEGER AS change FROM e WINDOW o AS (PARTITION BY r ORDER BY p))),
g AS (SELECT *, coalesce(first_value(before) OVER (PARTITION BY r, run ORDER BY p) = 'bullet', false) AS waits, last_value(follows) OVER (PARTITION BY r, run ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_kind,
 min(CASE WHEN kind = 'word' AND (token IN ({_LIST(layout.role_starts)}) AND after IN ({_LIST(layout.role_ends)}) OR token IN ({_LIST(layout.degrees)}) OR token IN ({_LIST(layout.degrees_of)}) AND after = 'of') THEN p END) OVER (PARTITION BY r, run) AS opens FROM f),
h AS (SELECT *, row_number() OVER w AS place, sum((token IN ({_LIST(RANGE_MARKS)}))::INTEGER) OVER w AS marks, (token IN ({_LIST(NOW_WORDS)}) OR {_YEAR.format("token")}) AND after NOT IN ('–', '-', 'to', 'Present') AND NOT {_YEAR.format("after")} AS ends
 FROM (SELECT *, CASE WHEN kind = 'word' AND waits AND (opens IS NULL OR p < opens) THEN 0 ELSE 1 END AS part FROM g) WINDOW w AS (PARTITION BY r, run, part ORDER BY p)),
cut AS (SELECT DISTINCT r, run, 0::BIGINT AS place, 0::HUGEINT AS marks FROM h WHERE kind = 'word' AND part = 1
 UNION ALL SELECT cut.r, cut.run, min(h.place), min(h.marks) FROM cut JOIN h ON h.r = cut.r AND h.run = cut.run AND h.kind = 'word' AND h.part = 1 AND h.ends AND h.place - cut.place >= 4 AND h.marks > cut.marks GROUP BY cut.r, cut.run, cut.place),
cl AS (SELECT r, run, list(place) AS places FROM cut WHERE place > 0 GROUP BY r, run),
l AS (SELECT r, run, 1 AS part, p * 3 + i AS seq, CASE i WHEN 1 THEN token ELSE '' END AS line FROM h, range(3) x(i) WHERE kind = 'header'
 UNION ALL SELECT r, run, 1, p, '{BULLET}' FROM h WHERE kind = 'bullet' AND NOT (follows IS NOT DISTINCT FROM 'word')
 UNION ALL SELECT r, run, 0, 0, '{BULLET} ' || string_agg(token, ' ' ORDER BY p) FROM h WHERE kind = 'word' AND part = 0 GROUP BY r, run
 UNION ALL SELECT DISTINCT r, run, 0, 1, '' FROM h WHERE kind = 'word' AND part = 0 AND opens IS NOT NULL
 UNION ALL SELECT r, run, 0, i, CASE i WHEN 0 THEN '{BULLET}' ELSE '' END FROM h, range(2) x(i) WHERE kind = 'word' AND waits AND p = opens AND before = 'bullet'
 UNION ALL SELECT r, run, 1, line, string_agg(token, ' ' ORDER BY p) FROM (SELECT h.r, h.run, p, token, len(list_filter(coalesce(places, []), lambda x: x < place)) AS line FROM h LEFT JOIN cl ON h.r = cl.r AND h.run = cl.run WHERE kind = 'word' AND part = 1) GROUP BY r, run, line),
k AS (SELECT *, lag(line) OVER (PARTITION BY r ORDER BY run, part, seq) AS b FROM l),
x AS (SELECT r, string_agg(line, chr(10) ORDER BY run, part, seq) AS text FROM k WHERE line <> '' OR coalesce(b, '') <> '' GROUP BY r)
SELECT doc_id, coalesce(regexp_replace(x.text, '^\n+', ''), '') AS text FROM t LEFT JOIN x USING (r)"""


NORMALIZE_SQL = _normalize_sql(STORED)


@query(NORMALIZE_SQL)
def normalize_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents rebuilt where they are read."""
    return rebuilt_texts(read(spark, sf, "documents"))


RECORDS_SQL = "(SELECT c_custkey AS doc_id, concat_ws(' ', c_name, 'SKILLS • Rust and Go • SQL', c_mktsegment, c_custkey % 40 || '.', 'did things Senior Engineer at Acme Jan 20' || lpad((c_custkey % 30)::VARCHAR, 2, '0'), CASE c_custkey % 3 WHEN 0 THEN '–' ELSE 'to' END, 'Present then TECHNICAL SKILLS & ABILITIES', c_custkey, 'EDUCATION Bachelor of Arts 2001 - 2004', c_nationkey, '◦ WORK EXPERIENCE •') AS text FROM customer)"


@query(_normalize_sql(STORED, RECORDS_SQL))
def normalize_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records written out as one line of headers, bullets, roles, degrees and dates, rebuilt."""
    return rebuilt_texts(_records(spark, sf))


@query(_normalize_sql(SHOWN, RECORDS_SQL))
def display_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The same records as the screen shows them: further headers, numbers in brackets, other role words."""
    return rebuilt_texts(_records(spark, sf), layout=SHOWN)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("c_custkey"), lambda x: F.col(x).cast("string")
    text = F.concat_ws(
        " ", "c_name", F.lit("SKILLS • Rust and Go • SQL"), "c_mktsegment", F.concat((k % 40).cast("string"), F.lit(".")), F.concat(F.lit("did things Senior Engineer at Acme Jan 20"), F.lpad((k % 30).cast("string"), 2, "0")),
        F.when(k % 3 == 0, "–").otherwise("to"), F.lit("Present then TECHNICAL SKILLS & ABILITIES"), s("c_custkey"), F.lit("EDUCATION Bachelor of Arts 2001 - 2004"), s("c_nationkey"), F.lit("◦ WORK EXPERIENCE •"),
    )
    return read(spark, sf, "customer").select(k.alias("doc_id"), text.alias("text"))


@query(NORMALIZE_SQL)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalized(F.col("text")).alias("text"))


def _resume_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Made-up résumés (parts), jobs (suppliers) and wanted skills."""
    p = read(spark, sf, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 20).cast("string").alias("job_id"), F.concat_ws("\n", "p_name", F.concat(F.lit("mail"), F.col("p_partkey"), F.lit("@example.com")), _skill_text("p_partkey", "p_type"), F.concat(F.col("p_size") % 12, F.lit("+ years of experience")), F.lit("EDUCATION"), F.lit("MBA, North School 2014")).alias("raw_text"))
    s = spark.range(20).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Job "), "id").alias("title"), F.concat(F.lit("We look for Java and Rust, job "), "id").alias("description"), F.lit(None).cast("double").alias("experience_required_years"), (F.col("id") % 4).cast("double").alias("min_experience_years"), F.when(F.col("id") % 3 == 0, (F.col("id") % 4 + 5).cast("double")).alias("max_experience_years"))
    skills = s.select(F.col("id").alias("job_id"), F.posexplode(F.array(F.lit("Java"), F.lit("rust"), F.lit("Kafka"))).alias("id", "skill")).withColumn("importance", F.when(F.col("id") < 2, "required").otherwise("nice-to-have"))
    return rows, s, skills


@query()
def screening(spark: SparkSession, sf: str) -> DataFrame:
    from rankloom.plans.screening import screened

    resumes_, jobs_, skills_ = _resume_texts(spark, sf)
    return screened(spread(resumes_), jobs_, skills_).drop("embedding")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid ranking: orders scored by four parts, ranked within their customer.

    An order's lines are summed as they are stored, so splits and shuffles don't change a score.
    """
    stored = F.struct("_metadata.file_name", "_metadata.row_index", "l_quantity", "l_discount", "l_tax").alias("line")
    li = read(spark, sf, "lineitem").select("l_orderkey", stored)
    lines = li.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    rows = lines.select("o_orderkey", "o_custkey", *(scoring.mean(F.col(f"lines.{c}")).alias(n) for c, n in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"))))
    s, e, m = F.least(F.col("q") * 2, F.lit(100.0)), F.col("d") * 1000, 100 - F.col("t") * 1000
    scored = rows.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("resume_id"), scoring.final_score(s, e, m, scoring.llm_fallback_score(scoring.deterministic_score(s, e))).alias("t"))
    return ranking.ranked(scored.select("job_id", "resume_id", F.col("t.overall").alias("overall_score")), "job_id", "overall_score", "resume_id")


@query("""WITH a AS (SELECT o_custkey AS job_id, o_orderkey AS resume_id, least(avg(l_quantity) * 2, 100.0)::DOUBLE AS s, avg(l_discount) * 1000 AS e, 100 - avg(l_tax) * 1000 AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT job_id, resume_id, round(s * 0.40 + e * 0.25 + m * 0.20 + greatest(10.0, least(98.0, greatest(0.0, least(100.0, s * 0.6 + e * 0.4)) * 0.7 + 25.0))::DOUBLE * 0.15, 1) AS overall_score FROM a)
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC NULLS LAST, resume_id) AS rank FROM t""")
def hybrid_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)
