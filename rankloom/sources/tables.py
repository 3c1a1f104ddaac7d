"""Reads of the stored tables: by key, by job, and the small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.store import load
from rankloom.schemas import conformed


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest version of a stored table, with columns that an older file lacks as null."""
    return conformed(load(spark, f"{root}/{name}"), name)


def row(df: DataFrame, value: str, key: str = "id"):
    """The one row of a key; raises if there is none."""
    found = df.where(F.col(key) == value).limit(1).collect()
    if not found:
        raise KeyError(f"{key} {value!r} not found")
    return found[0]


def of_job(df: DataFrame, job_id: str) -> DataFrame:
    return df.where(F.col("job_id") == job_id)


def raw_text(resumes: DataFrame, resume_id: str) -> str | None:
    return row(resumes.select("id", "raw_text"), resume_id)["raw_text"]


def models_by_size(models: DataFrame) -> DataFrame:
    return models.orderBy("size_bytes", "id")


def active_model(models: DataFrame) -> DataFrame:
    """The active model that has a file, if any."""
    return models.where("is_active AND file_path IS NOT NULL").orderBy("id").limit(1)


def models_like(models: DataFrame, pattern: str, column: str = "id") -> DataFrame:
    """Case-insensitive LIKE; an underscore stands for any character."""
    return models.where(F.col(column).ilike(pattern))


def candidates_by_email(candidates: DataFrame, email: str) -> DataFrame:
    return candidates.where(F.lower("email") == email.strip().lower())


def pipeline_events(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One event for each row whose status changed between two versions of a table."""
    old = before.select(key, F.col("status").alias("_old"))
    changed = after.join(old, key, "left").where(~F.col("status").eqNullSafe(F.col("_old")))
    return changed.select(F.col(key).alias("item_id"), "job_id", F.col("_old").alias("from_status"), F.col("status").alias("event"), F.current_timestamp().alias("at"))
