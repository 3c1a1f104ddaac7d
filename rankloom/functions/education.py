"""Degrees, institutions and years from free text, as an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.schemas import EDUCATION

# Headings, degree patterns, institution words.
OPENINGS, EXACT_OPENINGS = ("EDUCATION", "ACADEMIC"), ("QUALIFICATIONS",)
CLOSINGS = ("EXPERIENCE", "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "EMPLOYMENT HISTORY", "CAREER HISTORY", "SKILLS", "TECHNICAL SKILLS", "PROJECTS", "KEY PROJECTS", "PERSONAL PROJECTS", "CERTIFICATIONS", "ACHIEVEMENTS", "AWARDS", "PUBLICATIONS", "LANGUAGES", "INTERESTS", "VOLUNTEER", "VOLUNTEERING", "SUMMARY", "PROFESSIONAL SUMMARY")
DEGREE_PATTERNS = (
    ("Bachelor", r"(?i)\b(Bachelor(?:'s)?(?:\s+of\s+[A-Za-z\s&]+)?|B\.?E\.?|B\.?Tech|B\.?S\.?(?:c)?|BCA|BBA)\b"),
    ("Master", r"(?i)\b(Master(?:'s)?(?:\s+of\s+[A-Za-z\s&]+)?|M\.?E\.?|M\.?Tech|M\.?S\.?(?:c)?|MCA|MBA)\b"),
    ("Ph.D", r"(?i)\b(Ph\.?D\.?|Doctorate(?:\s+of\s+[A-Za-z\s&]+)?)\b"),
    ("Associate Degree", r"(?i)\b(Associate(?:'s)?(?:\s+Degree|\s+of\s+[A-Za-z\s&]+)?)\b"),
    ("Diploma", r"(?i)\b(Diploma(?:\s+in\s+[A-Za-z\s&]+)?)\b"),
)
YEAR_PATTERN = r"\b(19\d{2}|20\d{2})\b"
SCHOOL_WORDS = ("University", "Institute", "College", "School", "Academy", "Polytechnic", "Campus")
PLAIN_DEGREES = ("bachelor", "master", "doctorate", "degree")
MOST = 3

_degrees = [(name, re.compile(p)) for name, p in DEGREE_PATTERNS]
_year = re.compile(YEAR_PATTERN)


def _edges_off(text: str) -> str:
    return re.sub(r"^[,\-|–—\s]+|[,\-|–—\s]+$", "", text)


def _heading(line: str) -> str:
    return re.sub(r"^[:\s]+|[:\s]+$", "", line).upper()


def _degree(line: str) -> tuple[str, str] | None:
    """(category, wording) of the first pattern that a line holds."""
    for name, pattern in _degrees:
        if m := pattern.search(line):
            return name, m.group().strip()
    return None


def _section(lines: list[str]) -> list[str]:
    """Lines under an education heading, up to the next other heading; further education headings are dropped."""
    out: list[str] = []
    inside = False
    for line in lines:
        h = _heading(line)
        if h.startswith(OPENINGS) or h in EXACT_OPENINGS:
            inside = True
        elif inside and h.startswith(CLOSINGS):
            break
        elif inside:
            out.append(line)
    return out


def _credible(line: str, wording: str) -> bool:
    """Outside a section a degree needs a school or plain words."""
    return any(w in line for w in SCHOOL_WORDS) or any(w in wording.lower() for w in PLAIN_DEGREES)


def _first_year(text: str) -> str | None:
    m = _year.search(text)
    return m.group() if m else None


def _without(text: str, *parts: str | None) -> str:
    """``text`` without any occurrence of the given parts, and without separators at its edges."""
    return _edges_off(re.sub("|".join(re.escape(p) for p in parts if p), "", text))


def _entry(line: str, following: str | None, category: str, wording: str) -> tuple[dict, bool]:
    """The record of a degree's line, and whether it took the following line as the school.

    A line is degree, year and the rest; the rest is the school if it is long enough or says so.
    Otherwise the following line lends its text and, if need be, its year.
    """
    year = _first_year(line)
    school = _without(line, wording, year)
    says = len(school.encode()) > 3 or any(w in school for w in SCHOOL_WORDS)
    lends = not says and following is not None and _heading(following) not in CLOSINGS and _degree(following) is None
    if lends:
        year = year or _first_year(following)
        school = (_without(following, year) if year else following) or school
    short = len(wording.encode()) <= 4 and " " not in wording
    return {"degree": f"{category} ({wording})" if short else wording, "institution": school or "Educational Institution", "year": year}, lends


def education_entries(text: str | None) -> list[dict]:
    """At most three records of degree, institution and year, in reading order."""
    lines = [s for s in (x.strip() for x in (text or "").split("\n")) if s]
    section = _section(lines)
    search, found, skip = section or lines, [], False
    for line, following in zip(search, [*search, None][1:], strict=True):
        if skip or len(found) == MOST:
            skip = False
            continue
        hit = _degree(line)
        if hit and (section or _credible(line, hit[1])):
            record, skip = _entry(line, following, *hit)
            found.append(record)
    return found


def education(text: Column) -> Column:
    @F.pandas_udf(f"array<{EDUCATION}>")
    def entries(texts: pd.Series) -> pd.Series:
        known = {t: education_entries(t) for t in texts.dropna().unique()}  # a batch's repeats are read once
        return texts.map(lambda t: known.get(t, []))

    return entries(text)
