"""Read models: job summaries, candidate listings, statuses, searches.

Large tables are aggregated before they are joined, and every join is an equi-join on
the job or the résumé, so rows of one job can be spread by partitioning on ``job_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.ranking import latest
from rankloom.schemas import IN_FLIGHT


def job_summary(jobs: DataFrame, resumes: DataFrame, shortlists: DataFrame) -> DataFrame:
    """Jobs that are not archived, with counts of candidates, shortlisted and in-flight résumés; newest first."""
    counted = resumes.groupBy("job_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("status").isin(*IN_FLIGHT)).alias("processing_count"))
    chosen = shortlists.where("status = 'shortlisted'").groupBy("job_id").agg(F.count(F.lit(1)).alias("shortlisted_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    own = [c for c in jobs.columns if c not in ("experience_required_years", "min_experience_years")]
    years = [c for c in ("experience_required_years", "min_experience_years") if c in jobs.columns]
    fallback = [F.coalesce(*(F.col(c) for c in (years if y == years[0] else years[::-1]))).alias(y) for y in years]
    joined = jobs.where("status <> 'archived'").join(counted, jobs["id"] == counted["job_id"], "left").drop("job_id").join(chosen, jobs["id"] == chosen["job_id"], "left").drop("job_id")
    return joined.select(*own, *fallback, zero("candidate_count"), zero("shortlisted_count"), zero("processing_count")).orderBy(F.desc("updated_at"), "id")


def job_summary_sql(jobs: str, resumes: str, shortlists: str) -> str:
    """The same with scalar subqueries, which the optimizer turns into the joins above."""
    states = ", ".join(f"'{s}'" for s in IN_FLIGHT)
    return f"""
        SELECT j.*, (SELECT count(*) FROM {resumes} r WHERE r.job_id = j.id) AS candidate_count,
               (SELECT count(*) FROM {shortlists} s WHERE s.job_id = j.id AND s.status = 'shortlisted') AS shortlisted_count,
               (SELECT count(*) FROM {resumes} r WHERE r.job_id = j.id AND r.status IN ({states})) AS processing_count
        FROM {jobs} j WHERE j.status <> 'archived'"""


def dashboard_totals(summary: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("_count", "s"))
    return summary.agg(F.count(F.lit(1)).alias("active_jobs"), total("candidate_count"), total("shortlisted_count"), total("processing_count"))


def job_with_skills(jobs: DataFrame, skills: DataFrame, order: str = "id") -> DataFrame:
    """Jobs with their skills as an array, in the skills' storage order."""
    listed = skills.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "skill", "importance"))), lambda s: F.struct(s["skill"].alias("skill"), s["importance"].alias("importance"))).alias("skills"))
    return jobs.join(listed, jobs["id"] == listed["job_id"], "left").drop("job_id").withColumn("skills", F.coalesce("skills", F.array().cast("array<struct<skill: string, importance: string>>")))


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one map; the last value of a key wins."""
    one = latest(settings, ["key"], F.desc_nulls_last("updated_at"), F.desc("value"))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def _joined(resumes: DataFrame, candidates: DataFrame, analysis: DataFrame, shortlists: DataFrame) -> DataFrame:
    """Every join by key. A shortlist row names the candidate or the résumé, so each résumé asks under
    both ids; the matches, narrow rows, are joined back by résumé."""
    r, c, a = (df.alias(n) for df, n in ((resumes, "r"), (candidates, "c"), (analysis, "a")))
    known = candidates.select(F.col("id").alias("_candidate"))
    asked = resumes.select(F.col("id").alias("_resume"), F.col("job_id").alias("_job"), "candidate_id").join(known, F.col("candidate_id") == F.col("_candidate"), "left")
    asked = asked.select("_resume", "_job", F.explode(F.array_distinct(F.array_compact(F.array("_candidate", "_resume")))).alias("_key"))
    found = shortlists.join(asked, (F.col("job_id") == F.col("_job")) & (F.col("candidate_id") == F.col("_key"))).alias("s")
    return (
        r.join(c, F.col("r.candidate_id") == F.col("c.id"), "left")
        .join(a, (F.col("a.resume_id") == F.col("r.id")) & (F.col("a.job_id") == F.col("r.job_id")), "left")
        .join(found, (F.col("s._resume") == F.col("r.id")) & (F.col("s._job") == F.col("r.job_id")), "left")
    )


def _listed() -> list[Column]:
    col = F.col
    identity = F.coalesce(col("c.id"), col("r.id"))
    analysis = F.when(
        col("a.id").isNotNull(),
        F.struct(
            col("a.id").alias("id"),
            identity.alias("candidate_id"),
            *(col(f"a.{n}").alias(n) for n in ("job_id", "resume_id", "overall_score", "skills_score", "experience_score", "semantic_score", "llm_score", "rank", "extracted_skills", "matched_skills", "missing_skills", "experience_years", "education", "previous_roles", "ai_summary", "strengths", "concerns")),
        ),
    )
    return [
        identity.alias("id"),
        col("r.id").alias("resume_id"),
        col("r.job_id").alias("job_id"),
        F.coalesce(col("c.name"), col("r.file_name")).alias("name"),
        col("c.email").alias("email"),
        col("c.phone").alias("phone"),
        col("c.location").alias("location"),
        col("r.status").alias("status"),
        col("r.error_message").alias("error_message"),
        col("r.uploaded_at").alias("uploaded_at"),
        F.coalesce(col("s.status"), F.lit("pending")).alias("shortlist_status"),
        col("s.notes").alias("notes"),
        analysis.alias("analysis"),
    ]


def listing_order() -> list[Column]:
    """Scored rows first, by falling score, then newest upload; ids settle ties."""
    score = F.col("analysis.overall_score")
    return [F.when(score.isNull(), 1).otherwise(0), F.desc_nulls_last(score), F.desc_nulls_last("uploaded_at"), F.asc_nulls_last("resume_id")]


def candidate_listing(resumes: DataFrame, candidates: DataFrame, analysis: DataFrame, shortlists: DataFrame) -> DataFrame:
    """Every résumé with its candidate, analysis (or null) and shortlist status. A shortlist row may
    name the candidate or the résumé; if both exist, a résumé has two rows."""
    return _joined(resumes, candidates, analysis, shortlists).select(*_listed())


def candidate_detail(resumes: DataFrame, candidates: DataFrame, analysis: DataFrame, shortlists: DataFrame, job_id: str, key: str) -> DataFrame:
    """One candidate of a job by candidate or résumé id, with the file's columns: the newest résumé."""
    files = [F.col(f"r.{n}").alias(n) for n in ("file_name", "file_path", "file_type", "file_size", "raw_text")]
    found = _joined(resumes.where(F.col("job_id") == job_id), candidates, analysis, shortlists).where((F.col("c.id") == key) | (F.col("r.id") == key))
    return found.select(*_listed(), *files).orderBy(F.desc_nulls_last("uploaded_at"), "resume_id").limit(1)


def searched(listing: DataFrame, text: str = "", status: str = "all", name: str = "name", email: str = "email", state: str = "shortlist_status") -> DataFrame:
    """Rows whose name or e-mail holds ``text`` and whose shortlist status fits."""
    hit = F.contains(F.lower(name), F.lit(text.lower())) | F.coalesce(F.contains(F.lower(email), F.lit(text.lower())), F.lit(False))
    fits = F.lit(True) if status == "all" else (F.coalesce(F.col(state), F.lit("")).isin("pending", "") if status == "pending" else F.col(state) == status)
    return listing.where(hit & fits)


def searched_jobs(jobs: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    hit = F.contains(F.lower("title"), F.lit(text.lower())) | F.coalesce(F.contains(F.lower("location"), F.lit(text.lower())), F.lit(False))
    return jobs.where(hit if status == "all" else hit & (F.col("status") == status))


def processing_status(queue: DataFrame, job_id: str | int | None = None) -> DataFrame:
    """Counters of the work queue: one row for a job (zeros if it has no work), else one for each job."""
    sums = [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("completed", "completed"), ("failed", "failed"), ("processing", "in_progress"), ("queued", "queued")))]
    if job_id is not None:
        return queue.where(F.col("job_id") == job_id).agg(*sums)
    return queue.groupBy("job_id").agg(*sums)


def progress(status: DataFrame, seconds_each: int = 8) -> DataFrame:
    """Percent done and seconds left; no seconds when nothing is active."""
    done = F.col("completed") + F.col("failed")
    active = F.col("in_progress") + F.col("queued")
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.round(F.try_divide(done * 100.0, F.col("total"))), F.lit(0.0)).cast("int")))
    return status.withColumn("percent", percent).withColumn("seconds_left", F.when(active > 0, (F.col("total") - done) * seconds_each))


def queue_order(queue: DataFrame, within: str | None = None) -> DataFrame:
    """Waiting work: highest priority first, then oldest. With ``within``, the ``position`` of each row
    in its group instead of one order over all."""
    waiting, order = queue.where("status = 'queued'"), [F.desc_nulls_last("priority"), F.asc("queued_at"), F.asc("id")]
    return numbered(waiting, within, *order) if within else waiting.orderBy(*order)


def duplicate_check(files: DataFrame, resumes: DataFrame) -> DataFrame:
    """Offered files (job_id, file_name, file_size) with the newest equal résumé of the job, if any."""
    key = ["job_id", "file_name", "file_size"]
    known = latest(resumes, key, F.desc_nulls_last("uploaded_at"), F.asc("id")).select(*key, F.col("id").alias("existing_resume_id"), F.col("uploaded_at").alias("existing_uploaded_at"), F.col("status").alias("existing_status"))
    return files.join(known, key, "left").withColumn("is_duplicate", F.col("existing_resume_id").isNotNull())


def duplicate_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("is_duplicate").alias("duplicates"), F.count_if(~F.col("is_duplicate")).alias("new_files"))


def valid_jobs(jobs: DataFrame) -> DataFrame:
    """Rows with the reasons why a form would refuse them; an empty array if none."""
    low, high = F.col("min_experience_years"), F.col("max_experience_years")
    title = F.length(F.trim(F.coalesce("title", F.lit(""))))
    tests = {
        "title": ~title.between(1, 100),
        "description": F.length(F.trim(F.coalesce("description", F.lit("")))) < 20,
        "min_experience": F.coalesce(low < 0, F.lit(False)),
        "max_experience": F.coalesce(high < 0, F.lit(False)),
        "range": F.coalesce(low > high, F.lit(False)),
    }
    return jobs.withColumn("problems", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in tests.items()))))


def distinct_skills(skills: DataFrame, order: str = "id") -> DataFrame:
    """A job's skills without repeats in another case: the first of each stays."""
    keyed = skills.withColumn("_k", F.lower(F.trim("skill")))
    return latest(keyed, ["job_id", "_k"], F.asc(order)).drop("_k")


def sorted_listing(listing: DataFrame, by: str = "score") -> DataFrame:
    """Screen order: score (none counts as -1), name, or upload order."""
    if by == "name":
        return listing.orderBy("name", "resume_id")
    if by == "score":
        return listing.orderBy(F.desc(F.coalesce("analysis.overall_score", F.lit(-1.0))), "resume_id")
    return listing.orderBy(*listing_order())


def numbered(df: DataFrame, group: str, *order: Column, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
