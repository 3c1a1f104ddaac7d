"""Text extraction, quality and labels as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the extractors.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
YEARS = r"(?i)(\d+(?:\.\d+)?)\+?\s*(?:years|yrs|year)\s*(?:of)?\s*(?:experience|exp)?"

# The skill catalog, in its order.
SKILL_CATALOG = (
    "Rust", "Python", "JavaScript", "TypeScript", "React", "React Native", "Next.js", "Vue", "Angular",
    "Node.js", "Express", "Django", "FastAPI", "Flask", "Go", "Golang", "C++", "C#", ".NET", "Java",
    "Spring Boot", "Kotlin", "Swift", "Flutter", "SQL", "PostgreSQL", "MySQL", "MongoDB", "Redis",
    "SQLite", "GraphQL", "REST API", "Docker", "Kubernetes", "AWS", "GCP", "Azure", "CI/CD", "Git",
    "Linux", "Terraform", "Tailwind CSS", "Redux", "Zustand", "Jest", "PyTest", "Machine Learning",
    "PyTorch", "TensorFlow", "Pandas", "NumPy", "Scikit-Learn", "NLP", "LLM", "Kafka", "RabbitMQ",
)

# Limits of a usable page.
MIN_WORDS, MIN_CHARS, MIN_PRINTABLE, MIN_LETTERS = 10, 30, 0.75, 15


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tenths(x: Column) -> Column:
    """Rounded to one decimal as ten times the binary value is to a whole one; ``F.round`` rounds the decimals it is written in."""
    return F.round(x * 10) / 10


def stripped(x: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank; only line feeds end a line."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda s: s != "")


#: The patterns with the same first match in time linear in the text: a run of characters is entered at its first one
#: only and never given back, as no later start in a run, or shorter end of it, can match where that fails.
LINEAR_EMAIL = rf"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++{EMAIL[EMAIL.index('@'):]}"
LINEAR_YEARS = r"(?i)(?<!\d)(\d++(?:\.\d++)?+)\+?+\s*+(?:years|yrs|year)\s*(?:of)?\s*(?:experience|exp)?"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def email(text: Column) -> Column:
    return _found(text, LINEAR_EMAIL, 0)


def phone(text: Column) -> Column:
    return _found(text, PHONE, 0)


def experience_years(text: Column) -> Column:
    """The first stated number of years, if between 0 and 40; no second try."""
    value = _found(text, LINEAR_YEARS, 1).try_cast("double")
    return F.when((value > 0) & (value < 40), value)


def name_line(text: Column) -> Column:
    """The first line that may be a name, else the first line, else ``Candidate``."""
    own = lines(text)
    plain = lambda s: ~(F.contains(s, F.lit("@")) | F.contains(s, F.lit("http")) | F.contains(s, F.lit(".com")))
    count = lambda s: F.size(F.split(s, r"(?U)\s+"))
    named = F.filter(own, lambda s: plain(s) & (F.octet_length(s) < 50) & count(s).between(2, 4))
    return F.coalesce(F.get(named, F.lit(0)), F.get(own, F.lit(0)), F.lit("Candidate"))


def _quoted(term: str) -> str:
    return "".join("\\" + c if c in ".+#/-" else c for c in term.lower())


def _edged(term: str) -> str:
    """A term between word edges; where it begins or ends with a sign, a word character must stand beside it."""
    return rf"\b{_quoted(term)}\b"


def skills(text: Column, catalog: Sequence[str] = SKILL_CATALOG) -> Column:
    """Catalog terms found between word edges, in catalog order.

    One pass finds the text's words; only terms whose first word is among them are tried as patterns.
    For catalogs of very many terms see ``operators.dictionary``.
    """
    first = {t: next(iter(re.findall(r"\w+", t.lower(), re.ASCII)), "") for t in catalog}
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(first[t]).alias("word"), F.lit(_edged(t)).alias("pattern")) for t in catalog))

    def found(low: Column) -> Column:
        words = F.array_intersect(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)), F.array(*(F.lit(w) for w in sorted(set(first.values()) - {""}))))
        return bound(words, lambda known: F.transform(F.filter(terms, lambda t: (F.array_contains(known, t["word"]) | (t["word"] == "")) & F.regexp_like(low, t["pattern"])), lambda t: t["term"]))

    return F.when(text.isNotNull(), bound(F.lower(text), found)).otherwise(F.array().cast("array<string>"))


def skill_union(first: Column, more: Column) -> Column:
    """``first``, then what ``more`` adds, told apart without regard to case; order is kept."""
    known = lambda have, s: F.exists(have, lambda x: F.lower(x) == F.lower(s))
    return F.aggregate(more, first, lambda have, s: F.when(known(have, s), have).otherwise(F.array_append(have, s)))


def page_quality(text: Column) -> Column:
    """struct(is_usable, word_count, char_count, printable_ratio, reason) of a page's text."""
    t = stripped(F.coalesce(text, F.lit("")))
    chars = F.length(t)
    count = F.when(chars > 0, F.size(F.split(t, r"(?U)\s+"))).otherwise(0)
    printable = F.length(F.regexp_replace(t, r"[\p{Cc}&&[^\n\t]]", ""))
    letters = F.length(F.regexp_replace(t, r"(?U)\P{IsAlphabetic}+", ""))
    ratio = F.when(chars > 0, F.try_divide(printable.cast("float"), chars.cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
    too_few = lambda what, n, least: F.format_string(f"Insufficient {what} count (%d < {least})", n)
    reason = (
        F.when(chars == 0, "Extracted text is empty")
        .when(ratio < F.lit(MIN_PRINTABLE).cast("float"), F.format_string(f"Low printable character ratio (%.2f < {MIN_PRINTABLE})", ratio))
        .when(count < MIN_WORDS, too_few("word", count, MIN_WORDS))
        .when(chars < MIN_CHARS, too_few("character", chars, MIN_CHARS))
        .when(letters < MIN_LETTERS, too_few("alphabetic character", letters, MIN_LETTERS))
    )
    return F.struct(reason.isNull().alias("is_usable"), count.alias("word_count"), chars.alias("char_count"), ratio.alias("printable_ratio"), F.coalesce(reason, F.lit("Text layer meets quality criteria")).alias("reason"))


def error_class(message: Column) -> Column:
    """``scanned`` if a failure says that a file has no text, else ``other``; null for none."""
    return F.when(F.lower(message).rlike("scanned|no extractable text|text layer"), "scanned").when(message.isNotNull(), "other")


def experience_label(low: Column, high: Column) -> Column:
    one = lambda x: F.replace(F.format_string("%.1f", x), F.lit(".0"), F.lit(""))
    has = lambda x: x.isNotNull() & (x > 0)
    return (
        F.when(has(low) & has(high) & (F.abs(low - high) < 1e-4), F.concat(one(low), F.lit(" years")))
        .when(has(low) & has(high), F.concat(one(low), F.lit(" - "), one(high), F.lit(" years")))
        .when(has(low), F.concat(one(low), F.lit("+ years")))
        .when(has(high), F.concat(F.lit("Up to "), one(high), F.lit(" years")))
        .otherwise("Not specified")
    )


def truncated(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def file_size_label(size: Column, largest: str = "TB") -> Column:
    """1024-based size with one decimal at most, in units up to ``largest``."""
    units = ("Bytes", "KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    step = F.least(F.floor(F.ln(size.cast("double")) / F.ln(F.lit(1024.0)) + 1e-12), F.lit(len(units) - 1))
    value = F.regexp_replace(F.format_string("%.1f", size / F.pow(F.lit(1024.0), step)), r"\.0$", "")
    return F.when(size > 0, F.concat_ws(" ", value, F.element_at(F.array(*map(F.lit, units)), (step + 1).cast("int")))).when(size == 0, "0 Bytes")


def remaining_label(seconds: Column) -> Column:
    """Seconds left in words; empty for what is no time."""
    s = seconds.cast("double")
    minutes = F.floor(s / 60)
    rest = F.round(s - minutes * 60).cast("long")
    return (
        F.when(s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf")), "")
        .when(s < 10, "< 10s remaining")
        .when(s < 60, F.format_string("%ds remaining", F.round(s).cast("long")))
        .when((minutes < 60) & (rest == 0), F.concat(F.format_string("About %d min", minutes), F.when(minutes > 1, "s").otherwise(""), F.lit(" remaining")))
        .when(minutes < 60, F.format_string("~%dm %ds remaining", minutes, rest))
        .otherwise(F.format_string("~%dh %dm remaining", F.floor(minutes / 60), minutes % 60))
    )


def date_label(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def word_ngrams(text: Column, n: int = 2, join: str = "_") -> Column:
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{IsDigit}+#.]+"), lambda w: w != "")
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), join))


def char_ngrams(word: Column, n: int) -> Column:
    starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(word, i, n))


def chunks(tokens: Column, size: int = 512, stride: int = 448) -> Column:
    """Overlapping slices of an array; the last one reaches the end."""
    n = F.size(tokens)
    last = F.when(n > size, F.ceil((n - size) / stride)).otherwise(0).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * stride + 1, size))).otherwise(F.array().cast("array<array<string>>"))
