"""Rebuilding lines from text that lost its layout: for rows in JVM expressions, for a single text in Python.

Tokens are first told apart by what they are (header, bullet, plain), which needs a
token and its next two only; plain tokens between headers and bullets then form runs,
and each run is cut where a role, a degree or the end of a date range says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BULLET = "●"

# Headers, role and degree words, bullets.
WIDE_SECTIONS = ("PROFESSIONAL SUMMARY", "EXECUTIVE SUMMARY", "TECHNICAL SKILLS", "SKILLS & ABILITIES", "CORE COMPETENCIES", "PROFESSIONAL EXPERIENCE", "WORK EXPERIENCE", "EMPLOYMENT HISTORY", "CAREER HISTORY", "KEY PROJECTS", "PERSONAL PROJECTS", "ACADEMIC BACKGROUND", "CERTIFICATIONS & LICENSES")
SECTIONS = ("SUMMARY", "PROFILE", "SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION", "CERTIFICATIONS", "ACHIEVEMENTS", "AWARDS", "PUBLICATIONS", "LANGUAGES", "INTERESTS", "VOLUNTEERING")
ROLE_STARTS = ("Software", "Senior", "Lead", "Product", "Frontend", "Backend", "Full-Stack", "Full", "Staff", "Principal", "Junior", "Head")
ROLE_ENDS = ("Engineer", "Developer", "Architect", "Designer", "Manager", "Development", "Director")
DEGREES = ("Bachelor", "Master", "B.E.", "B.Tech", "B.S.", "M.S.", "M.Tech", "Ph.D", "PhD", "MBA", "MCA")
BULLETS = "•●▪▫*‣◦⁃∙"
RANGE_MARKS, NOW_WORDS = ("—", "-", "–"), ("Present", "Current")


@dataclass(frozen=True)
class Layout:
    """Word lists of a layout; ``wide_numbers`` takes a number in brackets as a bullet, too."""

    wide: tuple[str, ...] = WIDE_SECTIONS
    single: tuple[str, ...] = SECTIONS
    role_starts: tuple[str, ...] = ROLE_STARTS
    role_ends: tuple[str, ...] = ROLE_ENDS
    degrees: tuple[str, ...] = DEGREES
    degrees_of: tuple[str, ...] = ("Bachelor", "Master")
    wide_numbers: bool = False


STORED = Layout()
#: What the screen shows: two more headers, numbers in brackets, other role words, and a degree's "of" needed.
SHOWN = Layout(
    wide=(*WIDE_SECTIONS, "VOLUNTEER EXPERIENCE"),
    single=(*SECTIONS, "QUALIFICATIONS"),
    role_starts=("Software", "Senior", "Lead", "Product", "Frontend", "Backend", "Full-Stack", "Staff", "Principal"),
    role_ends=("Engineer", "Developer", "Architect", "Designer", "Manager", "Development"),
    degrees=("B.E.", "B.Tech", "B.S.", "M.S."),
    wide_numbers=True,
)


def _capitals(token: str) -> bool:
    letters = [c for c in token if c.isalpha()]
    return bool(letters) and all(map(str.isupper, letters))


def _is_bullet(token: str, layout: Layout) -> bool:
    if token in BULLETS and len(token) == 1:
        return True
    core = token[1:] if layout.wide_numbers and token.startswith("(") and token.endswith(")") else token
    return 2 <= len(core.encode()) <= 3 and core[-1] in ".)" and core[:-1].isascii() and core[:-1].isdigit()


def _is_year(token: str) -> bool:
    return len(token) == 4 and token.isascii() and token.isdigit() and token[:2] in ("19", "20")


def _marked(tokens: list[str], layout: Layout) -> Iterator[tuple[str, str, str]]:
    """(kind, token, next token); a header's words come as one."""
    skip = 0
    for at, token in enumerate(tokens):
        if skip:
            skip -= 1
            continue
        after = tokens[at + 1] if at + 1 < len(tokens) else ""
        size = next((n for n in (3, 2) if " ".join(tokens[at : at + n]) in layout.wide and all(map(_capitals, tokens[at : at + n]))), 0)
        if not size and _capitals(token) and token.upper() in layout.single and after not in ("&", "and") and not after.endswith(":"):
            size = 1
        if size:
            yield "header", " ".join(tokens[at : at + size]).upper(), ""
            skip = size - 1
        else:
            yield ("bullet" if _is_bullet(token, layout) else "word"), token, after


def _run_lines(run: list[tuple[str, str]], bulleted: bool, layout: Layout) -> Iterator[str]:
    """Lines of a run of words: a role or degree leaves a bullet, a date range ends a line."""
    line: list[str] = [BULLET] if bulleted else []
    for token, after in run:
        opens = (token in layout.role_starts and after in layout.role_ends) or token in layout.degrees or (token in layout.degrees_of and after == "of")
        if opens and bulleted:
            yield " ".join(line)
            yield ""
            line, bulleted = [], False
        line.append(token)
        ends = (token in NOW_WORDS or _is_year(token)) and after not in ("–", "-", "to", "Present") and not _is_year(after)
        if ends and not bulleted and len(line) >= 4 and any(m in line for m in RANGE_MARKS):
            yield " ".join(line)
            line = []
    if line:
        yield " ".join(line)


def rebuilt(raw: str | None, layout: Layout = STORED) -> str:
    """Headers between blank lines, a line for each bullet and dated entry; blank lines never repeat."""
    out: list[str] = []
    bulleted = False  # a bullet waits for its words
    for kind, part in groupby(_marked((raw or "").split(), layout), key=lambda m: m[0]):
        marks = list(part)
        if kind == "word":
            out += _run_lines([(token, after) for _, token, after in marks], bulleted, layout)
            bulleted = False
            continue
        if bulleted:
            out.append(BULLET)
        bulleted = kind == "bullet"
        out += [BULLET] * (len(marks) - 1) if bulleted else [x for _, header, _ in marks for x in ("", header, "")]
    if bulleted:
        out.append(BULLET)
    return "\n".join(line for at, line in enumerate(out) if line or (at and out[at - 1])).lstrip("\n")


# The same over columns. A text becomes its tokens, each behind a blank; patterns then set signs into it: HEAD before a
# header or bullet, NAMED between a header's words and a bullet's sign, TEXT behind both; OPENS before a role or degree, ENDS
# behind what may end a dated line. All are white space, so no token holds one.
HEAD, NAMED, TEXT, OPENS, ENDS = "\x1e", "\x1c", "\x1f", "\x1d", "\n"
#: Words before which a date range goes on, and the words that a dated line has at least.
GOES_ON, LEAST_WORDS = ("–", "-", "to", "Present"), 4
_YEAR, _STOP, _NEXT = "(?:19|20)[0-9]{2}", f"(?=[ {HEAD}{NAMED}{TEXT}{ENDS}])", f"[ {HEAD}]{NAMED}?"


def _any(words: Iterable[str]) -> str:
    return "(?:" + ("|".join(map(re.escape, words)) or "(?!)") + ")"


def _kinds_pattern(layout: Layout) -> str:
    """Headers (group 1) and bullets (group 2), found from left to right as ``_marked`` takes them."""
    wide = [w for w in map(str.split, layout.wide) if 2 <= len(w) <= 3 and all(map(_capitals, w))]
    single = [s for s in layout.single if _capitals(s) and s == s.upper()]
    header = f"{_any(' '.join(w) for w in sorted(wide, key=len, reverse=True))}(?= )|{_any(single)}(?= )(?! (?:&|and) | [^ ]*: )"
    bullet = f"[{re.escape(BULLETS)}]|[0-9]{{1,2}}[.)]" + (r"|\([0-9]{1,2}\)" if layout.wide_numbers else "")
    begins = "".join(map(re.escape, sorted({w[0][0] for w in wide} | {s[0] for s in single} | {*BULLETS, "("})))
    return f" (?=[0-9{begins}])(?:({header})|({bullet}))(?= )"


def _signed(text: Column, layout: Layout) -> Column:
    """The text's tokens with signs between them; only texts with a range mark have ENDS, only such with a bullet OPENS."""
    from rankloom.functions.text import bound

    blanks = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), r"(?U)[\s\x1c-\x1f]+", " ")
    kinds = F.regexp_replace(blanks, _kinds_pattern(layout), f"{HEAD}$1{NAMED}$2{TEXT}")
    may_end = f" ({_any(NOW_WORDS)}|{_YEAR})(?=[ {HEAD}])(?!{_NEXT}(?:{_any(GOES_ON)}|{_YEAR}){_STOP})"
    begins = "".join(map(re.escape, sorted({w[0] for w in (*layout.role_starts, *layout.degrees, *layout.degrees_of)})))
    word = f"{_any(layout.role_starts)}{ENDS}?{_NEXT}{_any(layout.role_ends)}{_STOP}|{_any(layout.degrees)}{_STOP}|{_any(layout.degrees_of)}{ENDS}?{_NEXT}of{_STOP}"
    opens = f" (?=[{begins}])(?={word})" if begins else "(?!)"
    dated = lambda t: F.when(t.rlike(f" [{''.join(map(re.escape, RANGE_MARKS))}][ {HEAD}]"), F.regexp_replace(t, may_end, f" $1{ENDS}")).otherwise(t)
    opened = lambda t: F.when(t.contains(HEAD + NAMED), F.regexp_replace(t, opens, f"{OPENS} ")).otherwise(t)
    return F.rtrim(bound(bound(kinds, dated), opened))


def _dated_lines(words: Column) -> Column:
    """The words, a line for each of their parts: one that may end a line does if enough words and a mark came since the last."""
    from rankloom.functions.text import bound

    def step(s: Column, piece: Column) -> Column:
        at, n = s["at"] + 1, s["words"] + F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))
        marked = s["marked"] | piece.rlike(f" [{''.join(map(re.escape, RANGE_MARKS))}](?= |$)")
        state = lambda n, marked, cuts: F.struct(at.alias("at"), n.alias("words"), marked.alias("marked"), cuts.alias("cuts"))
        return F.when((n >= LEAST_WORDS) & marked, state(F.lit(0), F.lit(False), F.array_append(s["cuts"], at))).otherwise(state(n, marked, s["cuts"]))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(False).alias("marked"), F.array().cast("array<int>").alias("cuts"))

    def lines(pieces: Column) -> Column:
        cuts = F.aggregate(pieces, start, step, lambda s: F.array_distinct(F.concat(F.array(F.lit(0)), s["cuts"], F.array(F.size(pieces)))))
        line = lambda c, k: F.substr(F.array_join(F.slice(pieces, F.get(c, k - 1) + 1, F.get(c, k) - F.get(c, k - 1)), ""), F.lit(2))
        return bound(cuts, lambda c: F.array_join(F.filter(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: line(c, k)), lambda x: x != ""), "\n"))

    return F.when(words.contains(ENDS), bound(F.split(words, ENDS), lines)).otherwise(F.substr(words, F.lit(2)))


def _part_lines(part: Column) -> Column:
    """Lines of a header or bullet and the words behind it, or of the words before the first one; null if there are none."""
    from rankloom.functions.text import bound

    words, name = F.substring_index(part, TEXT, -1), F.translate(F.substring_index(part, NAMED, 1), OPENS + ENDS, "")
    without = lambda w, sign: F.when(w.contains(sign), F.translate(w, sign, "")).otherwise(w)
    free = lambda w: bound(without(w, OPENS), _dated_lines)

    def hung(w: Column) -> Column:
        """Words hang on their bullet up to a role or degree."""
        bullet = lambda first: F.concat(F.lit(BULLET), without(first, ENDS))
        return F.when(w.contains(OPENS), bound(F.substring_index(w, OPENS, 1), lambda first: F.concat(bullet(first), F.lit("\n\n"), free(F.substr(w, F.length(first) + 2))))).otherwise(bullet(w))

    behind = lambda w, before: F.when(w == "", F.lit("")).otherwise(F.concat(F.lit(before), free(w)))
    return bound(words, lambda w: F.when(part.startswith(NAMED), hung(w)).when(part.contains(TEXT), F.concat(F.lit("\n"), name, F.lit("\n"), behind(w, "\n"))).when(w != "", free(w)))


def normalized(text: Column, layout: Layout = STORED) -> Column:
    """``rebuilt`` in JVM expressions: patterns over the whole text, then its headers and bullets one by one."""
    lines = F.array_join(F.transform(F.split(_signed(text, layout), HEAD), _part_lines), "\n")
    return F.ltrim(F.regexp_replace(lines, "\n{3,}", "\n\n"), F.lit("\n"))


def combined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", layout: Layout | None = STORED) -> DataFrame:
    """One row per document: its pages' normalised texts in order, joined by blank lines.

    Empty pages are left out, and so is a page equal to the one before it.
    With ``layout`` None the texts are only trimmed.
    """
    from rankloom.functions.text import stripped
    from rankloom.session import spread

    own = pages.select(F.col(doc), F.col(page).alias("_page"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = (spread(own) if layout else own).withColumn("_text", stripped(normalized(F.col("_text"), layout) if layout else F.col("_text")))
    before = Window.partitionBy(doc).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    # Pages are told apart behind the window: a filter on their texts would be moved to where they are read, and rebuild each one a second time.
    told = own.withColumn("_text", F.nullif("_text", F.lit(""))).withColumn("_before", F.last("_text", ignorenulls=True).over(before))
    kept = F.col(doc).isNotNull() & F.col("_text").isNotNull() & ~F.col("_text").eqNullSafe(F.col("_before"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("_page", "_text")))), lambda s: s["_text"]), "\n\n")
    return told.groupBy(doc).agg(joined.alias("text"))
