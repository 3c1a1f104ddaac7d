"""Writes as new versions of tables: upserts, deletes and state changes.

Plain Parquet tables have no MERGE, so each function takes the present table and the
change and returns the next version, lazily; ``save`` lands it beside the present one
and swaps. Keys are joined once; the untouched rows are never shuffled for their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.cascade import REFERENCES, Reference, deleted
from rankloom.operators.ranking import latest, ranked_in_ranges


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id", "created_at"), fill: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Rows replace those of the same key; ``keep`` columns stay as first stored, ``fill``
    columns keep the old value where the new one is null. Of several new rows of a key
    the last by ``order`` wins."""
    new = latest(rows, keys, F.desc(order)) if order else rows.dropDuplicates(keys)
    if order and order not in table.columns:
        new = new.drop(order)
    known = F.col("o._here").isNotNull()
    incoming = F.col("n._new").isNotNull()
    joined = table.withColumn("_here", F.lit(1)).alias("o").join(new.withColumn("_new", F.lit(1)).alias("n"), keys, "full_outer")
    out: list[Column] = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in fill:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(incoming, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def upserted_candidates(candidates: DataFrame, arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """Candidates after arrivals (id, name, email, phone, location, created_at, ``order``).

    An e-mail identifies a candidate without regard to case; without one an arrival is a
    new candidate. Arrivals of one e-mail are folded in their order: the last name wins, and the
    last phone and location that are not null. They update the stored candidate of that e-mail, of
    several the one with the smallest id; all other stored rows stay as they are.
    """
    blank = F.trim(F.coalesce(F.col("email"), F.lit(""))) == ""
    key = F.when(blank, F.concat(F.lit("id:"), F.col("id"))).otherwise(F.concat(F.lit("mail:"), F.lower(F.trim("email"))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, "id"))).alias(c)
    first = lambda c: F.min_by(c, F.struct(order, "id")).alias(c)
    folded = arrivals.groupBy(key.alias("_key")).agg(first("id"), F.max_by("name", F.struct(order, "id")).alias("name"), first("email"), last("phone"), last("location"), first("created_at"))
    stored_key = F.when(blank, F.concat(F.lit("id:"), F.col("id"))).otherwise(F.concat(F.lit("mail:"), F.lower("email")))
    held = candidates.select(stored_key.alias("_key"), F.col("id").alias("_held")).groupBy("_key").agg(F.min("_held").alias("_held"))
    placed = folded.join(held, "_key", "left")
    change = placed.where("_held IS NOT NULL").select(F.col("_held").alias("id"), F.col("name").alias("_name"), F.col("phone").alias("_phone"), F.col("location").alias("_location"), F.lit(True).alias("_hit"))
    newer = {"name": F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("name")), "phone": F.coalesce("_phone", "phone"), "location": F.coalesce("_location", "location")}
    kept = candidates.join(change, "id", "left").withColumns(newer).select(*candidates.columns)
    return kept.unionByName(placed.where("_held IS NULL").drop("_key", "_held"), allowMissingColumns=True).select(*candidates.columns)


#: Keys that are sent to every task; more of them are joined by shuffling.
KEYS_SENT = 100_000


def parted(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` whose ``key`` is among ``keys`` (one column, distinct; null is a key), and the others.
    Few keys (they are counted) are broadcast, so that neither part is shuffled."""
    named = keys.select(F.col(key).alias("_key"))
    sent = F.broadcast(named) if named.limit(KEYS_SENT + 1).count() <= KEYS_SENT else named
    same = F.col(key).eqNullSafe(F.col("_key"))
    return table.join(sent, same, "left_semi"), table.join(sent, same, "left_anti")


def _reranked(analysis: DataFrame, hot_rows: int) -> DataFrame:
    return ranked_in_ranges(analysis.drop("rank"), "job_id", "overall_score", "resume_id", hot_rows=hot_rows)


def upserted_analysis(analysis: DataFrame, rows: DataFrame, order: str | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """Analyses by (résumé, job). Only the jobs that ``rows`` name are joined and ranked anew; all others
    pass through with the ranks they have. A job of more than ``hot_rows`` rows is ranked in ranges of its scores."""
    touched, others = parted(analysis, rows.select("job_id").distinct(), "job_id")
    new = rows.drop("rank") if "rank" in rows.columns else rows
    merged = upserted(touched.drop("rank"), new, ["resume_id", "job_id"], order=order)
    return others.unionByName(_reranked(merged, hot_rows).select(*analysis.columns))


def updated_jobs(jobs: DataFrame, skills: DataFrame, vectors: DataFrame, changes: DataFrame, new_skills: DataFrame) -> dict[str, DataFrame]:
    """Changed jobs, their skills replaced, their vectors dropped (they are made again from the new text)."""
    touched = changes.select(F.col("id").alias("job_id")).distinct()
    change = changes.withColumn("min_experience_years", F.coalesce("min_experience_years", "experience_required_years")).withColumn("experience_required_years", F.col("min_experience_years"))
    return {
        "jobs": upserted(jobs, change, ["id"], keep=("created_at",)),
        "job_skills": skills.join(touched, "job_id", "left_anti").unionByName(new_skills.join(touched, "job_id", "left_semi"), allowMissingColumns=True),
        "job_embeddings": vectors.join(touched, "job_id", "left_anti"),
    }


def archived(jobs: DataFrame, ids: list[str]) -> DataFrame:
    hit = F.col("id").isin(ids)
    return jobs.withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")))


def deleted_jobs(tables: dict[str, DataFrame], gone: DataFrame, references: Sequence[Reference] = REFERENCES) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the jobs of ``gone`` (job_id) and what hangs on them by the declared references, and the paths of
    the files to remove. Candidates left without a résumé go too, with their shortlist rows."""
    out, lost = deleted(tables, {"jobs": gone.select(F.col("job_id").alias("id"))}, references)
    return out, lost["resumes"].select("file_path")


def deleted_resumes(tables: dict[str, DataFrame], gone: DataFrame, rerank: bool = True, references: Sequence[Reference] = REFERENCES, hot_rows: int = 1_000_000) -> dict[str, DataFrame]:
    """All tables without the résumés of ``gone`` (resume_id) and what hangs on them. The ranks of the jobs
    that lose an analysis close up unless ``rerank`` is off; other jobs keep theirs."""
    out, lost = deleted(tables, {"resumes": gone.select(F.col("resume_id").alias("id"))}, references)
    if rerank and "candidate_analysis" in lost:
        touched, others = parted(out["candidate_analysis"], lost["candidate_analysis"].select("job_id").distinct(), "job_id")
        columns = tables["candidate_analysis"].columns
        out["candidate_analysis"] = others.unionByName(_reranked(touched, hot_rows).select(*columns))
    return out


def orphan_candidates(candidates: DataFrame, resumes: DataFrame) -> DataFrame:
    return candidates.join(resumes.select(F.col("candidate_id").alias("id")), "id", "left_anti")


#: States that end work on a résumé.
ENDED = ("completed", "failed")


def _in_order(changes: DataFrame, order: str | None) -> Column:
    """What repeated changes of a key are ordered by: ``order``, then what they say."""
    return F.struct(*([order] if order else []), "status", "error_message")


def resume_status(resumes: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Résumés after changes (id, status, error_message): the error is replaced, even by null, and the
    time of processing is set once a résumé is completed or failed. Several changes of one résumé are folded in the order of
    the column ``order``; a change without a status changes nothing."""
    last = F.max_by(F.struct("status", "error_message"), _in_order(changes, order))
    c = changes.where("status IS NOT NULL").groupBy("id").agg(last.alias("_to"), F.bool_or(F.col("status").isin(*ENDED)).alias("_ended"))
    joined = resumes.join(c, "id", "left")
    hit = F.col("_to").isNotNull()
    return joined.withColumns({
        "status": F.when(hit, F.col("_to.status")).otherwise(F.col("status")),
        "error_message": F.when(hit, F.col("_to.error_message")).otherwise(F.col("error_message")),
        "processed_at": F.when(F.col("_ended"), F.current_timestamp()).otherwise(F.col("processed_at")),
    }).select(*resumes.columns)


def _with_values(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced, even by null, in the rows that ``changes`` (``key``, ``column``; one row a key) names."""
    c = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return table.join(c, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*table.columns)


def resume_texts(resumes: DataFrame, changes: DataFrame) -> DataFrame:
    """Résumés with the extracted texts of ``changes`` (id, raw_text)."""
    return _with_values(resumes, changes, "id", "raw_text")


def resume_candidates(resumes: DataFrame, changes: DataFrame) -> DataFrame:
    """Résumés linked to the candidates of ``changes`` (id, candidate_id)."""
    return _with_values(resumes, changes, "id", "candidate_id")


def queue_status(queue: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Queue rows after changes (resume_id, status, error_message): a start counts an attempt, an end notes its time. Starts and
    completions leave the error; a failure and any other state replace it, even by null. Several changes of one
    résumé are folded in the order of the column ``order``; a change without a status changes nothing."""
    rank, status = _in_order(changes, order), F.col("status")
    c = changes.where("status IS NOT NULL").groupBy("resume_id").agg(
        F.max_by("status", rank).alias("_s"),
        F.max_by(F.struct("error_message"), F.when(~status.isin("processing", "completed"), rank)).alias("_e"),
        F.count_if(status == "processing").alias("_starts"),
        F.bool_or(status.isin(*ENDED)).alias("_ended"),
    )
    return queue.join(c, "resume_id", "left").withColumns({
        "status": F.coalesce("_s", "status"),
        "attempts": F.col("attempts") + F.coalesce("_starts", F.lit(0)),
        "started_at": F.when(F.col("_starts") > 0, F.current_timestamp()).otherwise(F.col("started_at")),
        "completed_at": F.when(F.col("_ended"), F.current_timestamp()).otherwise(F.col("completed_at")),
        "error_message": F.when(F.col("_e").isNotNull(), F.col("_e.error_message")).otherwise(F.col("error_message")),
    }).select(*queue.columns)


def enqueued(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """A résumé's new entry replaces its old one."""
    return queue.join(rows.select("resume_id").distinct(), "resume_id", "left_anti").select(*queue.columns).unionByName(rows, allowMissingColumns=True)


def reconciled(queue: DataFrame) -> DataFrame:
    """After a crash: what was in work waits again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def retried(resumes: DataFrame, queue: DataFrame, gone_again: Column) -> tuple[DataFrame, DataFrame]:
    """Résumés for which ``gone_again`` holds wait again, with a fresh queue entry of priority 0."""
    again = resumes.where(gone_again)
    entry = again.select(
        F.sha2(F.concat_ws(":", F.lit("queue"), "id"), 256).alias("id"), "job_id", F.col("id").alias("resume_id"), F.lit(0).cast("long").alias("priority"),
        F.lit(0).cast("long").alias("attempts"), F.lit(3).cast("long").alias("max_attempts"), F.lit("queued").alias("status"), F.current_timestamp().alias("queued_at"),
    )
    waiting = resumes.withColumn("error_message", F.when(gone_again, None).otherwise(F.col("error_message"))).withColumn("status", F.when(gone_again, "queued").otherwise(F.col("status")))
    return waiting, enqueued(queue, entry)


def single_active(models: DataFrame, model_id: str) -> DataFrame:
    return models.withColumn("is_active", F.col("id") == model_id)


def patched(listing: DataFrame, key: str, status: str, notes: str | None = None) -> DataFrame:
    """One candidate's shortlist status and, if given, notes, changed in a listing."""
    hit = (F.col("id") == key) | (F.col("resume_id") == key)
    out = listing.withColumn("shortlist_status", F.when(hit, status).otherwise(F.col("shortlist_status")))
    return out.withColumn("notes", F.when(hit, notes).otherwise(F.col("notes"))) if notes else out


def without(listing: DataFrame, key: str) -> DataFrame:
    """A listing without one candidate or résumé."""
    return listing.where(~(F.col("id").eqNullSafe(F.lit(key)) | F.col("resume_id").eqNullSafe(F.lit(key))))


def latest_by_text(docs: DataFrame, text: str, order: Column) -> DataFrame:
    """One row for each text, the last by ``order``."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).orderBy(order))).where("_n = 1").drop("_n")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that ``save`` has put in place."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]


def saved(spark: SparkSession, path: str) -> bool:
    from rankloom.operators import buckets

    return bool(_versions(spark, path)) or buckets.is_bucketed(spark, path)


def save(df: DataFrame, path: str, partition_by: str | None = None, keep: int = 2) -> None:
    """Lands a new version of a table; ``path`` is a folder of versions, the newest is read. One writer at a time.
    The newest ``keep`` versions stay, for readers of the last one; older ones go."""
    spark = df.sparkSession
    number = 1 + max(_versions(spark, path), default=0)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    staging = f"{path}/_v{number}"
    writer.mode("overwrite").parquet(staging)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(staging), at(f"{path}/v{number}")):
        raise OSError(f"version {number} of {path} could not be put in place")
    for old in sorted(_versions(spark, path))[:-keep]:
        fs.delete(at(f"{path}/v{old}"), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that ``save`` has put in place, or the rows of a table in buckets."""
    from rankloom.operators import buckets

    numbers = _versions(spark, path)
    if not numbers and buckets.is_bucketed(spark, path):
        return buckets.read_buckets(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.parquet(f"{path}/v{max(numbers)}")
