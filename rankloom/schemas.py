"""Schemas of the screening tables, with typed nested columns instead of JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKILL = "struct<skill: string, importance: string>"
EDUCATION = "struct<degree: string, institution: string, year: string>"
ROLE = "struct<title: string, company: string, duration: string>"

_DDL = {
    "settings": "key string, value string, updated_at timestamp",
    "models": "id string, display_name string, tier string, file_name string, download_url string, sha256 string, size_bytes bigint, file_path string, status string, is_active boolean, downloaded_at timestamp",
    "jobs": "id string, title string, description string, location string, employment_type string, experience_required_years double, min_experience_years double, max_experience_years double, status string, created_at timestamp, updated_at timestamp",
    "job_skills": "id string, job_id string, skill string, importance string",
    "candidates": "id string, name string, email string, phone string, location string, created_at timestamp",
    "resumes": "id string, candidate_id string, job_id string, file_name string, file_path string, file_type string, file_size bigint, raw_text string, status string, error_message string, uploaded_at timestamp, processed_at timestamp",
    "candidate_analysis": "id string, candidate_id string, job_id string, resume_id string, overall_score double, skills_score double, experience_score double, semantic_score double, llm_score double, rank bigint, extracted_skills array<string>, "
    f"matched_skills array<{SKILL}>, missing_skills array<{SKILL}>, experience_years double, education array<{EDUCATION}>, previous_roles array<{ROLE}>, ai_summary string, strengths array<string>, concerns array<string>, created_at timestamp, updated_at timestamp",
    "shortlists": "id string, job_id string, candidate_id string, status string, notes string, updated_at timestamp",
    "processing_queue": "id string, job_id string, resume_id string, priority bigint, attempts bigint, max_attempts bigint, status string, error_message string, queued_at timestamp, started_at timestamp, completed_at timestamp",
    "embeddings": "id string, resume_id string, job_id string, embedding array<float>, created_at timestamp",
    "job_embeddings": "job_id string, embedding array<float>, updated_at timestamp",
}

TABLES = tuple(_DDL)

# States.
IN_FLIGHT = ("pending", "queued", "extracting", "analyzing")
QUEUE_STATES = ("queued", "processing", "completed", "failed")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; columns that an older file lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields))
