"""Scoring as column expressions: skills, experience, blends, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import bound, stripped, tenths

# Weights of the final score.
WEIGHTS = {"skills": 0.40, "experience": 0.25, "semantic": 0.20, "llm": 0.15}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean(values: Column) -> Column:
    """The mean of an array, summed in its order; nulls don't count, of nothing it is null."""
    held = F.filter(values.cast("array<double>"), lambda x: x.isNotNull())
    return bound(held, lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double")))


def match_skills(required: Column, offered: Column) -> Column:
    """struct(score, matched, missing) for ``required`` array<struct<skill, importance>>
    and ``offered`` array<string>.

    An exact hit counts the skill's weight (1 if required, else 0.5); a mutual substring
    counts 0.6 of a required one and all of another. Without requirements the score is 100.
    """
    clean = F.transform(F.coalesce(offered, F.array().cast("array<string>")), lambda s: stripped(F.lower(s)))
    return bound(F.struct(required.alias("r"), clean.alias("c")), lambda x: bound(_graded(x["r"], x["c"]), lambda rows: _summed(x["r"], rows)))


def _graded(required: Column, have: Column) -> Column:
    """Each wanted skill with whether it is required, whether it is met, and what that counts."""

    def graded(s: Column) -> Column:
        want = stripped(F.lower(s["skill"]))
        exact = F.array_contains(have, want)
        close = F.exists(have, lambda c: F.contains(c, want) | F.contains(want, c))
        must = s["importance"].eqNullSafe("required")
        return F.struct(
            s["skill"].alias("skill"),
            s["importance"].alias("importance"),
            must.alias("must"),
            (exact | close).alias("hit"),
            F.when(must, F.when(exact, 1.0).when(close, 0.6).otherwise(0.0)).otherwise(F.when(exact | close, 0.5).otherwise(0.0)).alias("got"),
        )

    return F.transform(required, graded)


def _summed(required: Column, rows: Column) -> Column:
    total = lambda keep, value: F.aggregate(F.filter(rows, keep), F.lit(0.0), lambda acc, r: acc + value(r))
    got = total(lambda r: r["must"], lambda r: r["got"]) + total(lambda r: ~r["must"], lambda r: r["got"])
    most = total(lambda r: r["must"], lambda r: F.lit(1.0)) + total(lambda r: ~r["must"], lambda r: F.lit(0.5))
    named = lambda hit: F.transform(F.filter(rows, lambda r: r["hit"] == F.lit(hit)), lambda r: F.struct(r["skill"].alias("skill"), r["importance"].alias("importance")))
    score = F.when(F.size(required) > 0, clamp(F.try_divide(got, most) * 100.0, 0.0, 100.0)).otherwise(100.0)
    return F.struct(score.alias("score"), named(True).alias("matched"), named(False).alias("missing"))


def match_experience(low: Column, high: Column, years: Column) -> Column:
    """0 to 100 for a wanted range of years; either end may be null or at most 0 (no limit)."""
    lo = F.greatest(F.coalesce(F.nanvl(low.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    hi = F.greatest(F.coalesce(F.nanvl(high.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    y = years.cast("double")
    share = F.try_divide(y, lo)
    in_range = F.when((y >= lo) & (y <= hi), 100.0).when(y < lo, clamp(share * 75.0, 0.0, 75.0)).otherwise(clamp(100.0 - F.least((y - hi) * 2.0, F.lit(10.0)), 85.0, 100.0))
    at_least = F.when(y >= lo, F.least(F.least(share, F.lit(1.5)) * 90.0, F.lit(100.0))).otherwise(share * 70.0)
    at_most = F.when(y <= hi, 100.0).otherwise(F.greatest(100.0 - F.least(y - hi, F.lit(5.0)) * 6.0, F.lit(60.0)))
    return (
        F.when((lo <= 0) & (hi <= 0), 100.0)
        .when(y.isNull() | F.isnan(y) | (y < 0), 50.0)
        .when((lo > 0) & (hi > 0) & (hi >= lo), in_range)
        .when(lo > 0, at_least)
        .otherwise(at_most)
    )


def deterministic_score(skills: Column, experience: Column) -> Column:
    return clamp(skills * 0.6 + experience * 0.4, 0.0, 100.0)


def llm_fallback_score(deterministic: Column) -> Column:
    return clamp(deterministic * 0.7 + 25.0, 10.0, 98.0)


def final_score(skills: Column, experience: Column, semantic: Column, llm: Column) -> Column:
    """struct of the weighted sum and its parts, each rounded to one decimal after the sum."""
    w = WEIGHTS
    overall = skills * w["skills"] + experience * w["experience"] + semantic * w["semantic"] + llm * w["llm"]
    parts = {"overall": overall, "skills": skills, "experience": experience, "semantic": semantic, "llm": llm}
    return F.struct(*(tenths(x).alias(name) for name, x in parts.items()))


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def hardware_tier(ram_gb: Column) -> Column:
    return F.when(ram_gb < 8, "fast").when(ram_gb <= 16, "balanced").otherwise("quality")
