"""Tolerant reading of JSON inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import bound, skill_union, stripped
from rankloom.schemas import EDUCATION, ROLE

CANDIDATE = f"name string, email string, phone string, location string, skills array<string>, experience_years string, education array<{EDUCATION}>, work_experience array<{ROLE}>, certifications array<string>, languages array<string>"
ANALYSIS = "llm_score string, summary string, strengths array<string>, concerns array<string>"


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")


def _outermost(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_object(raw: Column) -> Column:
    """The JSON object in an answer: that of the first closed code fence, else the outermost braces; repaired."""
    t = stripped(raw)
    fenced = F.regexp_extract(t, r"(?s)^.*?```(?:[^\n]*\n)?(.*?)```", 1)
    return without_trailing_commas(F.coalesce(_outermost(fenced), _outermost(t)))


def decoded_array(text: Column, ddl: str) -> Column:
    """An array column kept as JSON text; what can't be read is empty."""
    return F.coalesce(F.from_json(text, ddl), F.from_json(F.lit("[]"), ddl))


def encoded_array(values: Column) -> Column:
    return F.coalesce(F.to_json(values), F.lit("[]"))


def _number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def _kept(values: Column) -> Column:
    """Trimmed and not empty; an absent list is empty."""
    return F.coalesce(F.filter(F.transform(values, stripped), lambda s: s != ""), F.array().cast("array<string>"))


def _full(x: Column) -> Column:
    return F.nullif(stripped(x), F.lit(""))


def _is_strict(parsed: Column, r: Column) -> Column:
    """Whether a parsed object has every field of a candidate in its own type."""
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    optional = lambda name: F.coalesce(kind(name).isin("STRING", "VOID"), F.lit(True))
    names = lambda name: kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")

    def records(name: str, a: str, b: str, c: str) -> Column:
        other = rf"^(?!.*\b({a}|{b}): (?!STRING))(?!.*\b{c}: (?!STRING|VOID)).*$"
        full = F.forall(r[name], lambda x: x[a].isNotNull() & x[b].isNotNull())
        return kind(name).startswith("ARRAY<") & kind(name).rlike(other) & full

    number = F.coalesce(kind("experience_years").rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(True))
    tests = [
        kind("name") == "STRING", *(optional(n) for n in ("email", "phone", "location")), names("skills"), number,
        records("education", "degree", "institution", "year"), records("work_experience", "title", "company", "duration"),
        *(F.coalesce(names(n), F.lit(True)) for n in ("certifications", "languages")),
    ]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def candidate(raw: Column) -> Column:
    """The candidate record of an answer, null if it holds no JSON object.

    An object with every field in its own type is taken as it stands; any other is
    read permissively, which trims, drops and fills.
    """
    return bound(json_object(raw), lambda text: bound(F.struct(F.from_json(text, CANDIDATE).alias("r"), F.try_parse_json(text).alias("p")), lambda s: _candidate(s["p"], s["r"])))


def _candidate(parsed: Column, r: Column) -> Column:
    listed = lambda name: F.coalesce(r[name], F.array().cast("array<string>"))
    as_is = F.struct(
        *(r[n].alias(n) for n in ("name", "email", "phone", "location", "skills")),
        r["experience_years"].try_cast("double").alias("experience_years"),
        *(r[n].alias(n) for n in ("education", "work_experience")),
        *(listed(n).alias(n) for n in ("certifications", "languages")),
    )
    name = F.when(~F.lower(stripped(r["name"])).isin("candidate", "unknown"), stripped(r["name"]))
    pair = lambda a, b: a.isNotNull() & b.isNotNull() & ((stripped(a) != "") | (stripped(b) != ""))
    schools = F.transform(
        F.filter(r["education"], lambda e: pair(e["degree"], e["institution"])),
        lambda e: F.struct(F.coalesce(_full(e["degree"]), F.lit("Degree")).alias("degree"), F.coalesce(_full(e["institution"]), F.lit("Institution")).alias("institution"), e["year"].alias("year")),
    )
    roles = F.transform(
        F.filter(r["work_experience"], lambda w: pair(w["title"], w["company"])),
        lambda w: F.struct(F.coalesce(_full(w["title"]), F.lit("Role")).alias("title"), F.coalesce(_full(w["company"]), F.lit("Company")).alias("company"), w["duration"].alias("duration")),
    )
    mail = _full(r["email"])
    record = F.struct(
        F.coalesce(name, F.lit("")).alias("name"),
        F.when(F.contains(mail, F.lit("@")), mail).alias("email"),
        _full(r["phone"]).alias("phone"),
        _full(r["location"]).alias("location"),
        _kept(r["skills"]).alias("skills"),
        _number(r["experience_years"]).alias("experience_years"),
        F.coalesce(schools, F.array().cast(f"array<{EDUCATION}>")).alias("education"),
        F.coalesce(roles, F.array().cast(f"array<{ROLE}>")).alias("work_experience"),
        F.coalesce(r["certifications"], F.array().cast("array<string>")).alias("certifications"),
        F.coalesce(r["languages"], F.array().cast("array<string>")).alias("languages"),
    )
    return F.when(_is_strict(parsed, r), as_is).when(parsed.isNotNull(), record)


def analysis(raw: Column, fallback: Column) -> Column:
    """struct(llm_score, summary, strengths, concerns), null without an object or a summary."""
    return bound(json_object(raw), lambda text: bound(F.struct(F.from_json(text, ANALYSIS).alias("r"), F.try_parse_json(text).alias("p")), lambda s: _analysis(s["p"], s["r"], fallback)))


def _analysis(parsed: Column, r: Column, fallback: Column) -> Column:
    # A number counts with its sign, a quoted score by its first digits.
    quoted = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.llm_score", "variant")) == "STRING", F.lit(False))
    signed = F.nullif(F.regexp_extract(r["llm_score"], r"^(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$", 1), F.lit("")).try_cast("double")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.when(~quoted, signed), _number(r["llm_score"]), fallback)))
    record = F.struct(score.alias("llm_score"), stripped(r["summary"]).alias("summary"), _kept(r["strengths"]).alias("strengths"), _kept(r["concerns"]).alias("concerns"))
    return F.when(_full(r["summary"]).isNotNull(), record)


def merged_candidate(answer: Column, heuristic: Column) -> Column:
    """Gaps of an answer filled from the heuristic record; skills united; roles are not merged."""
    return bound(F.struct(answer.alias("a"), heuristic.alias("h")), lambda s: _merged(s["a"], s["h"]))


def _merged(answer: Column, heuristic: Column) -> Column:
    unnamed = F.lower(stripped(answer["name"])).isin("", "candidate")
    years = F.coalesce(F.when(answer["experience_years"] != 0, answer["experience_years"]), heuristic["experience_years"], answer["experience_years"])
    return (
        answer.withField("name", F.when(unnamed, heuristic["name"]).otherwise(answer["name"]))
        .withField("email", F.coalesce(answer["email"], heuristic["email"]))
        .withField("phone", F.coalesce(answer["phone"], heuristic["phone"]))
        .withField("location", F.coalesce(answer["location"], heuristic["location"]))
        .withField("experience_years", years)
        .withField("skills", skill_union(answer["skills"], heuristic["skills"]))
        .withField("education", F.when(F.size(answer["education"]) > 0, answer["education"]).otherwise(heuristic["education"]))
    )
