"""The screening plan: texts and jobs in, scored and ranked analyses out, as one lazy plan."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import json_repair, scoring, text, vectors
from rankloom.functions.education import education
from rankloom.functions.embedding import embedding
from rankloom.operators.ranking import ranked, ranked_in_ranges
from rankloom.plans.answers import answered_prompts
from rankloom.session import checkpointed

Generate = Callable[[str], str]


def heuristic_candidate(raw: Column) -> Column:
    """The record read from a text by patterns alone."""
    return F.struct(
        text.name_line(raw).alias("name"),
        text.email(raw).alias("email"),
        text.phone(raw).alias("phone"),
        F.lit(None).cast("string").alias("location"),
        text.skills(raw).alias("skills"),
        text.experience_years(raw).alias("experience_years"),
        education(raw).alias("education"),
        F.array().cast("array<struct<title: string, company: string, duration: string>>").alias("work_experience"),
        F.array().cast("array<string>").alias("certifications"),
        F.array().cast("array<string>").alias("languages"),
    )


# Sentences of the heuristic analysis.
SAID = {
    "skills": "Demonstrated proficiency across %d relevant technical competencies",
    "in_range": "Aligned with target experience range (%.1f - %.1f years) with %.1f years in the field",
    "below_range": "Has %.1f years of experience vs %.1f - %.1f years required for this position",
    "above_range": "Brings %.1f years of extensive background, exceeding the %.1f year upper range",
    "meets": "Meets or exceeds experience requirement with %.1f years in the field",
    "misses": "Has %.1f years of experience vs %.1f+ years specified for this position",
    "within": "Fits within target experience range (up to %.1f years) with %.1f years",
    "seasoned": "Brings %.1f years of seasoned background",
    "plain": "Brings %.1f years of professional background",
    "school": "Educational credential: %s from %s",
    "no_skills": "Key required tech stack keywords not explicitly highlighted in resume",
    "summary": "%s presents a profile for the %s position with a baseline deterministic match of %.0f%%. Demonstrates experience in %s with notable background across relevant projects.",
    "no_focus": "core engineering disciplines",
}


def heuristic_analysis(candidate: Column, title: Column, wanted: Column, low: Column, high: Column, deterministic: Column) -> Column:
    """struct(llm_score, summary, strengths, concerns) from templates."""
    f = lambda key, *args: F.format_string(SAID[key], *args)
    related = lambda a, b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    hits = F.size(F.filter(candidate["skills"], lambda s: F.exists(wanted, lambda w: related(w, s))))
    y, has_low, has_high = candidate["experience_years"], F.coalesce(low > 0, F.lit(False)), F.coalesce(high > 0, F.lit(False))
    both = has_low & has_high
    strength = F.when(y.isNotNull(),
        F.when(both & y.between(low, high), f("in_range", low, high, y)).when(both & (y > high), f("above_range", y, high)).when(both, None)
        .when(has_low & (y >= low), f("meets", y)).when(has_low, None)
        .when(has_high & (y <= high), f("within", high, y)).when(has_high, f("seasoned", y)).otherwise(f("plain", y)))
    concern = F.when(both & (y < low), f("below_range", y, low, high)).when(has_low & ~has_high & (y < low), f("misses", y, low))
    first = F.get(candidate["education"], F.lit(0))
    school = F.when(first.isNotNull(), f("school", first["degree"], first["institution"]))
    focus = F.when(F.size(candidate["skills"]) > 0, F.array_join(F.slice(candidate["skills"], 1, 3), ", ")).otherwise(SAID["no_focus"])
    return F.struct(
        scoring.llm_fallback_score(deterministic).alias("llm_score"),
        f("summary", candidate["name"], title, deterministic, focus).alias("summary"),
        F.array_compact(F.array(F.when(hits > 0, f("skills", hits)), strength, school)).alias("strengths"),
        F.array_compact(F.array(concern, F.when((hits == 0) & (F.size(wanted) > 0), SAID["no_skills"]))).alias("concerns"),
    )


# What prompts are cut to, in characters.
PROMPT_CHARS, RETRY_CHARS, ANSWER_CHARS, DESCRIPTION_CHARS = 6000, 4000, 1000, 500


def extraction_prompt(raw: Column) -> Column:
    schema = "name, email, phone, location, skills, experience_years, education (degree, institution, year), work_experience (title, company, duration), projects"
    return F.concat(F.lit(f"Read the resume and answer with one JSON object with the keys {schema}.\n\nResume:\n"), text.truncated(raw, PROMPT_CHARS))


def analysis_prompt(candidate: Column, title: Column, description: Column, wanted: Column, low: Column, high: Column, deterministic: Column) -> Column:
    joined = lambda values, none: F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(none)
    schools = F.transform(candidate["education"], lambda e: F.format_string("%s (%s)", e["degree"], e["institution"]))
    roles = F.transform(candidate["work_experience"], lambda w: F.format_string("%s at %s", w["title"], w["company"]))
    listed = lambda values: F.when(F.size(values) > 0, F.array_join(values, "; ")).otherwise("None listed")
    lines = {
        "Job": title,
        "Required skills": joined(wanted, "None specified"),
        "Experience": text.experience_label(low, high),
        "Description": text.truncated(description, DESCRIPTION_CHARS),
        "Candidate": candidate["name"],
        "Skills": joined(candidate["skills"], "None extracted"),
        "Years": F.coalesce(F.format_string("%.1f", candidate["experience_years"]), F.lit("Not specified")),
        "Education": listed(schools),
        "Roles": listed(roles),
        "Baseline": F.format_string("%.1f", deterministic),
    }
    head = F.lit("Answer with one JSON object with the keys llm_score, summary, strengths, concerns.")
    return F.concat_ws("\n", head, *(F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()))


def answered(answer: str | None) -> dict | None:
    """The JSON object of an answer, once trailing commas are gone."""
    m = re.search(r"\{.*\}", answer or "", re.S)
    try:
        found = json.loads(re.sub(r",\s*([}\]])", r"\1", m.group())) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def readable(answer: str | None) -> bool:
    return answered(answer) is not None


def summarised(answer: str | None) -> bool:
    """Whether an answer is an analysis: an object with a summary that is not blank."""
    summary = (answered(answer) or {}).get("summary")
    return isinstance(summary, str) and summary.strip() != ""


#: Shape of a candidate record, for the second try.
RECORD_SHAPE = '{{"name": text, "email": text or null, "phone": text or null, "location": text or null, "skills": [text], "experience_years": number or null, "education": [{{"degree": text, "institution": text, "year": text or null}}], "work_experience": [{{"title": text, "company": text, "duration": text or null}}]}}'
EXTRACTION_RETRY = "Your last answer could not be read as a candidate record:\n{bad}\n\nAnswer again, with nothing but one JSON object of this shape:\n" + RECORD_SHAPE + "\n\n{prompt}"
ANALYSIS_RETRY = "Your last answer was no analysis; it needs a JSON object with at least a summary:\n{bad}\n\nAnswer again, with nothing but that object.\n\n{prompt}"


def generated(df: DataFrame, prompt: Column, key: str, generate: Generate, retry: str = EXTRACTION_RETRY, fits: Callable[[str | None], bool] = readable) -> DataFrame:
    """``key`` and ``answer`` of a plugged-in model for each row: one try, one retry with the bad answer
    if it doesn't fit, null if the model fails."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ask in batch["p"]:
                try:
                    answer = generate(ask)
                    if not fits(answer):
                        answer = generate(retry.format(bad=(answer or "")[:ANSWER_CHARS], prompt=ask[:RETRY_CHARS]))
                except Exception:  # a model that fails leaves the heuristic result
                    answer = None
                out.append(answer)
            yield pd.DataFrame({key: batch[key], "answer": out})

    return df.select(key, prompt.alias("p")).mapInPandas(task, f"{key} {df.schema[key].dataType.simpleString()}, answer string")


def screened(resumes: DataFrame, jobs: DataFrame, job_skills: DataFrame, generate: Generate | None = None, answers: str | None = None, hot_rows: int | None = None, **bounds: object) -> DataFrame:
    """Analyses of résumés (id, job_id, raw_text) against their jobs, ranked within each job.

    With ``answers``, a folder, the model's answers are kept there by prompt: equal prompts are asked once and a rerun asks
    only what is open; ``bounds`` are those of ``answered_prompts``. With ``hot_rows`` the analyses are computed once, and a job of more rows is ranked in
    ranges of its scores.

    Job vectors are made once for each job; jobs are small beside résumés, so the join
    may broadcast them, which the optimizer decides by size.
    """

    def ask(df: DataFrame, prompt: Column, key: str, retry: str, fits: Callable[[str | None], bool], step: str) -> DataFrame:
        if answers is None:
            return generated(df, prompt, key, generate, retry, fits)
        again = lambda p, bad: retry.format(bad=(bad or "")[:ANSWER_CHARS], prompt=p[:RETRY_CHARS])
        return answered_prompts(df, prompt, key, lambda prompts: [generate(p) for p in prompts], f"{answers}/{step}", fits, again, **bounds).drop("tries")

    wanted = job_skills.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", "skill", "importance"))).alias("_s"))
    wanted = wanted.select(F.col("job_id").alias("_skill_job"), F.transform("_s", lambda s: F.struct(s["skill"].alias("skill"), s["importance"].alias("importance"))).alias("_wanted"))
    job = jobs.join(wanted, jobs["id"] == F.col("_skill_job"), "left").select(
        F.col("id").alias("_job"), F.col("title").alias("_title"), F.col("description").alias("_description"),
        F.coalesce("min_experience_years", "experience_required_years").alias("_low"), F.col("max_experience_years").alias("_high"),
        F.coalesce("_wanted", F.array().cast("array<struct<skill: string, importance: string>>")).alias("_wanted"), embedding(F.col("description")).alias("_job_vector"),
    )
    read = resumes.select(F.col("id").alias("resume_id"), "job_id", "raw_text", heuristic_candidate(F.col("raw_text")).alias("candidate"), embedding(F.col("raw_text")).alias("embedding"))
    if generate:
        said = ask(resumes, extraction_prompt(F.col("raw_text")), "id", EXTRACTION_RETRY, readable, "extraction").withColumnRenamed("id", "resume_id")
        parsed = json_repair.candidate(F.col("answer"))
        read = read.join(said, "resume_id", "left").withColumn("candidate", F.when(parsed.isNotNull(), json_repair.merged_candidate(parsed, F.col("candidate"))).otherwise(F.col("candidate"))).drop("answer")
        read = checkpointed(read)  # the model is asked once, whatever reads its answers
    met = read.join(job, F.col("job_id") == F.col("_job"))
    c = F.col("candidate")
    skills = scoring.match_skills(F.col("_wanted"), c["skills"])
    scored = met.withColumn("_skills", skills).withColumn("_experience", scoring.match_experience(F.col("_low"), F.col("_high"), c["experience_years"]))
    scored = scored.withColumn("_semantic", vectors.semantic_score_of_texts(F.col("raw_text"), F.col("_description"), vectors.cosine_similarity(F.col("embedding"), F.col("_job_vector"))))
    scored = scored.withColumn("_det", scoring.deterministic_score(F.col("_skills.score"), F.col("_experience")))
    names = F.transform("_wanted", lambda s: s["skill"])
    scored = scored.withColumn("_said", heuristic_analysis(c, F.col("_title"), names, F.col("_low"), F.col("_high"), F.col("_det")))
    if generate:
        said = ask(scored, analysis_prompt(c, F.col("_title"), F.col("_description"), names, F.col("_low"), F.col("_high"), F.col("_det")), "resume_id", ANALYSIS_RETRY, summarised, "analysis")
        scored = scored.join(said, "resume_id", "left").withColumn("_said", F.coalesce(json_repair.analysis(F.col("answer"), F.col("_said.llm_score")), F.col("_said")))
    total = scoring.final_score(F.col("_skills.score"), F.col("_experience"), F.col("_semantic"), F.col("_said.llm_score"))
    out = scored.withColumn("_total", total).select(
        F.sha2(F.concat_ws(":", "resume_id", "job_id"), 256).alias("id"), "resume_id", "job_id",
        *(F.col(f"_total.{k}").alias(f"{k}_score") for k in ("overall", "skills", "experience", "semantic", "llm")),
        c["name"].alias("name"), c["email"].alias("email"), c["skills"].alias("extracted_skills"),
        F.col("_skills.matched").alias("matched_skills"), F.col("_skills.missing").alias("missing_skills"), c["experience_years"].alias("experience_years"),
        c["education"].alias("education"), c["work_experience"].alias("previous_roles"),
        F.col("_said.summary").alias("ai_summary"), F.col("_said.strengths").alias("strengths"), F.col("_said.concerns").alias("concerns"), "embedding",
    )
    if hot_rows is not None:
        return ranked_in_ranges(checkpointed(out), "job_id", "overall_score", "resume_id", hot_rows=hot_rows)
    return ranked(out, "job_id", "overall_score", "resume_id")
