"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (e-mail, IP address, card number, phone number by fixed patterns) always stay. Looser candidates are added where
the final classifier is sure: addresses spelled out in several languages, phone numbers as written nationally or behind 00, card
numbers of 13 to 15 digits, and the numbers inside a run that the base patterns drop as a whole (two cards in a row, a phone number
with more digits behind it). Numbers of a card's length whose check digit fails are candidates, too: they teach what a number looks like
that is none. Five labelers vote yes, no or nothing on every candidate: the strict pattern, a validity rule (check
digit, number ranges), a gazetteer (domain endings, calling codes, issuers), the words around, and the edges.

The words around are learned, in whatever languages the corpus has: a first pass counts, over all documents, the words near base spans of
each kind, and those near places all through the texts (one in ``EVERY`` characters); what stands near spans significantly more
often (or less) than elsewhere is a cue, at most ``MOST_CUES`` a kind, beside a few given ones. A second pass counts (kind, votes, size)
over all documents: a small table, whatever the input. Expectation-maximisation on
these counts estimates each labeler's reliabilities for each kind; it is told no truth but that candidates which fail their validity
rule are none. A logistic classifier is trained on its posteriors.

Spans are code points of the text, end exclusive. Edge cases: a null text is empty and
has no spans; a corpus without candidates trains nothing and adds nothing; very long
runs of digits or letters take linear time; repeated rows and null ids stay as they
are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import prepare, sliced, staged, staging

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}").finditer  # a digit run is tried once, from its start
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer

# Looser candidates.
# Lengths are those of the mail standards: 64 characters before the mark, 63 a label. A word "at" alone marks an
# address only if some dot is spelled too.
_AT, _DOTS = "at|arroba|arobase|arobas|chiocciola|ät", "dot|punto|point|punkt|ponto"
_LOCAL, _LABEL, _DOT = r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}", rf"\s?(?:\[(?:{_DOTS})\]|\((?:{_DOTS})\)|\s(?:{_DOTS})\s)\s?"
_spelled = re.compile(rf"{_LOCAL}(?:\s?(?:\[(?:{_AT})\]|\((?:{_AT})\))\s?{_LABEL}(?:(?:{_DOT}|\s\.\s|\.){_LABEL})+|\s(?:{_AT})\s\s?{_LABEL}(?:{_DOT}{_LABEL})+)", re.I).finditer
_bracketed_at = re.compile(rf"\[(?:{_AT})\]|\((?:{_AT})\)", re.I).search
_lone_at = re.compile(rf"\s(?:{_AT})\s", re.I).search
_dot_word = re.compile(_DOTS, re.I).search
#: National numbers: three groups; a leading 0 and two to five groups; nine digits in groups, as 912 34 56 78; and 00 in place of +.
_national = re.compile(
    r"(?<![\w+.,/-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?(?: ?/ ?|[ .-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|00[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![\w-]|[.,/][0-9])"
).finditer
#: The first number of a run that has too many digits: a calling code and groups.
_called = [re.compile(rf"\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:[ .-][0-9]{{2,4}}){{{n}}}(?![0-9])").match for n in (4, 3, 2)]
_numbers = re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]){9,15}(?![\w-])").finditer
_groups = re.compile(r"[0-9]+").finditer
_digit = re.compile("[0-9]").search
_word = re.compile(r"[^\W\d_]{2,}").findall

# Gazetteers and cue words.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt br mx in jp cn ru".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "852", "886", "966", "971", "972")
YES_WORDS = {
    "email": ("mail", "contact", "write", "reach", "@"),
    "ip": ("ip", "host", "server", "address", "login", "connect"),
    "card": ("card", "visa", "master", "amex", "payment", "credit"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "contact"),
}
NO_WORDS = ("version", "license", "licence", "token", "isbn", "section", "figure", "order no")

VOTES = 5
#: Characters before and after a span in which the context labeler looks for its words.
BEFORE, AFTER = 40, 20
#: Characters between the places whose words stand for the corpus; uses, significance and number of a learned cue.
EVERY, LEAST_USES, LEAST_Z, MOST_CUES = 2048, 5, 4.0, 500


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = []
    at = text.find("@")
    last = 0
    while at >= 0:
        before = text[last:at]
        local = len(before) - len(before.rstrip(LOCAL_PART))
        m = _domain(text, at + 1) if local else None
        if m:
            found.append(("email", at - local, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _digit(text):
        found += [("ip", m.start(), m.end()) for m in _ip(text) if _parts_fit(m.group())]
        for m in _card(text):
            d = _digits(m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _phone(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def _inside(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Card numbers of a digit run that is none as a whole: its groups of 13 to 19 digits, and four groups of four."""
    groups = [(start + m.start(), start + m.end()) for m in _groups(text[start:end])]
    found, at = [], 0
    while at < len(groups):
        a, b = groups[at]
        if 13 <= b - a <= 19:
            found.append(("card", a, b))
            at += 1
        elif at + 4 <= len(groups) and all(y - x == 4 for x, y in groups[at : at + 4]) and luhn(_digits(text[a : groups[at + 3][1]])):
            found.append(("card", a, groups[at + 3][1]))
            at += 4
        else:
            at += 1
    return found


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that touch no base span and no earlier candidate of their kind, leftmost of each kind first."""
    found = []
    if _bracketed_at(text) or (_lone_at(text) and _dot_word(text)):  # every match holds one of these
        found += [("email", m.start(), m.end()) for m in _spelled(text)]
    if _digit(text):
        taken = {(a, b) for kind, a, b in base if kind == "card"}
        for m in _card(text):
            if m.end() - m.start() >= 13 and m.span() not in taken:
                n = len(_digits(m.group()))
                if n > 19:
                    found += _inside(text, *m.span())
                elif n >= 13:
                    found += [("card", x.start(), x.end()) for x in _numbers(text, m.start(), m.end())]
        if "+" in text:
            for m in _phone(text):
                if len(_digits(m.group())) > 15:  # the longest beginning that is a number and leaves base spans alone
                    cut = (x.span() for called in _called if (x := called(text, m.start(), m.end())) and 8 <= len(_digits(x.group())) <= 15)
                    found += [("phone", *c) for c in cut if all(c[1] <= a or b <= c[0] for _, a, b in base)][:1]
        found += [("phone", m.start(), m.end()) for m in _national(text) if 8 <= len(_digits(m.group())) <= 15]
    free, ends = [], {}
    for kind, a, b in sorted(found, key=lambda c: (KINDS.index(c[0]), c[1], -c[2])):
        if a >= ends.get(kind, 0) and all(b <= x or y <= a for _, x, y in base):
            free.append((kind, a, b))
            ends[kind] = b
    return free


class Cues:
    """Words that speak for or against a kind: given ones as parts of what stands around, learned ones as whole words."""

    def __init__(self, learned: dict[str, dict[str, int]] | None = None):
        self.learned = learned or {}

    def vote(self, text: str, kind: str, start: int, end: int) -> int:
        near, own = around(text, start, end), self.learned.get(kind, {})
        told = sum(own.get(w, 0) for w in set(_word(near))) if own else 0
        if any(w in near for w in YES_WORDS[kind]) or told > 0:
            return 1
        return -1 if any(w in near for w in NO_WORDS) or told < 0 else 0


def around(text: str, start: int, end: int) -> str:
    """What stands around a span; a word that the window cuts counts as it is cut."""
    return (text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]).lower()


def learned_cues(docs: DataFrame, text_col: str = "text") -> Cues:
    """Cues from all documents: words whose share of the windows around base spans differs from that of places all through
    the texts. Equal windows count once, so copies of a document teach no more than one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen: set[tuple[str, str]] = set()
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update((kind, around(text, a, b)) for kind, a, b in base_spans(text))
                    # From a place that the text itself draws, so short texts are met in their share, too.
                    seen.update(("", around(text, at, at)) for at in range(zlib.crc32(text.encode()) % EVERY, len(text), EVERY))
            if seen:
                kinds, windows = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(windows)], names=["kind", "window"])

    with staging(docs.sparkSession):
        windows = docs.select(F.col(text_col).cast("string")).mapInArrow(task, "kind string, window string").distinct()
        words = F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all("window", F.lit(r"\p{L}{2,}"), F.lit(0)))))
        counts = staged(windows.select("kind", words.alias("word")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")), "private-words")
        total = {r["kind"]: r["n"] for r in counts.where("word = ''").collect()}  # a row a kind
        learned: dict[str, dict[str, int]] = {}
        elsewhere = counts.where("kind = '' AND word <> ''").select("word", F.col("n").alias("m"))
        for kind in (k for k in KINDS if total.get(k) and total.get("")):
            met = counts.where((F.col("kind") == kind) & (F.col("word") != "")).select("word", "n").join(elsewhere, "word", "full_outer").na.fill(0, ["n", "m"])
            one, other = F.col("n") / total[kind], F.col("m") / total[""]
            both = (F.col("n") + F.col("m")) / (total[kind] + total[""])
            z = (one - other) / F.sqrt(both * (1 - both) * (1 / total[kind] + 1 / total[""]) + 1e-12)
            told = met.where(F.col("n") + F.col("m") >= LEAST_USES).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(MOST_CUES).collect()
            learned[kind] = {r["word"]: 1 if r["z"] > 0 else -1 for r in told}
    return Cues(learned)


def votes(text: str, kind: str, start: int, end: int, strict: bool, cues: Cues) -> tuple[int, ...]:
    """One vote of each labeler: 1 yes, -1 no, 0 nothing."""
    span = text[start:end]
    digits = _digits(span)
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", span.lower())[-1]
        listed = 1 if ending in ENDINGS else -1
        valid = 1 if len(ending) >= 2 and ending.isalpha() and (strict or listed > 0) else -1  # words spelled around "at" end in a known ending
    elif kind == "ip":
        valid = 1 if _parts_fit(span) else -1
        listed = 0 if span.split(".")[0] in ("0", "127", "255") else 1
    elif kind == "card":
        valid = 1 if luhn(digits) else -1
        listed = 1 if digits[:1] in ("4", "5") or digits[:2] in ("34", "37", "35", "60", "65", "62") or "2221" <= digits[:4] <= "2720" else -1
    else:
        valid = 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        called = digits[2:] if digits.startswith("00") else digits if span.startswith("+") else ""
        listed = (1 if called.startswith(CALLING_CODES) else -1) if called else 0
    context = cues.vote(text, kind, start, end)
    edges = -1 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else 1
    return (1 if strict else 0, valid, listed, context, edges)


def pattern(text: str, kind: str, start: int, end: int, strict: bool, cues: Cues) -> tuple[int, ...]:
    """What the classifier sees of a candidate: kind, votes, size class."""
    return (KINDS.index(kind), *votes(text, kind, start, end, strict, cues), min((end - start) // 4, 7))


class SpanClassifier:
    """EM over vote patterns, then logistic regression on its posteriors."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 60):
        keys = np.array(sorted(counts), int)
        n = np.array([counts[tuple(k)] for k in keys.tolist()], float)
        truth = np.zeros(len(keys))
        self.reliability: dict[str, np.ndarray] = {}
        for kind in range(len(KINDS)):
            at = np.flatnonzero(keys[:, 0] == kind)
            if len(at):
                truth[at], self.reliability[KINDS[kind]] = self._em(keys[at, 1 : 1 + VOTES], n[at], rounds)
        x = self._features(keys)
        w = np.zeros(x.shape[1])
        scale = n / n.sum()
        for _ in range(400):
            p = 1 / (1 + np.exp(-x @ w))
            # Newton's step with a small ridge.
            h = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (scale * (p - truth)) + 1e-4 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def _em(v: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each pattern, and P(vote | truth) as [labeler, truth, vote + 1]."""
        fits = v[:, 1] >= 0  # what fails its validity rule is none: the one thing that is known beforehand
        post = fits / (1 + np.exp(-1.5 * v.sum(1)))  # start: the vote
        for _ in range(rounds):
            weight = np.stack([n * (1 - post), n * post])
            prior = (weight.sum(1) + 1) / (n.sum() + 2)
            # Pseudo-counts say that a labeler is better than chance; they settle kinds with few candidates.
            table = np.stack([[[(weight[y] * (v[:, j] == x)).sum() + (20 if x == 2 * y - 1 else 10 if x == 0 else 2) for x in (-1, 0, 1)] for y in (0, 1)] for j in range(VOTES)])
            table = table / table.sum(2, keepdims=True)
            logs = np.log(prior)[:, None] + sum(np.log(table[j][:, v[:, j] + 1]) for j in range(VOTES))
            post = fits / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        return post, table

    @staticmethod
    def _features(keys: np.ndarray) -> np.ndarray:
        kind = np.eye(len(KINDS))[keys[:, 0]]
        said = [np.eye(3)[keys[:, 1 + j] + 1] for j in range(VOTES)]
        return np.concatenate([kind, *said, np.eye(8)[keys[:, -1]]], 1)

    def probability(self, key: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(self._features(np.array([key])) @ self.weights)[0])))


def candidate_counts(docs: DataFrame, cues: Cues, text_col: str = "text") -> dict[tuple[int, ...], int]:
    """Counts of (kind, votes, size class) over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(cues)  # at most MOST_CUES words a kind

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update(pattern(text, *s, True, shared.value) for s in base)
                    seen.update(pattern(text, *s, False, shared.value) for s in loose_spans(text, base))
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(task, "k array<int>, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["k"]): r["n"] for r in rows}


def find_private_data(docs: DataFrame, sure: float = 0.8, id_col: str = "doc_id", text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``spans``: array of (kind, start, end, base, score), by kind, then start. Labelers are
    weighed on ``learn_from``, else on the documents themselves."""
    prepare(docs.sparkSession)
    source = docs if learn_from is None else learn_from
    cues = learned_cues(source, text_col)
    counts = candidate_counts(source, cues, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(cues)
    model = SpanClassifier(counts) if counts else None
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_t"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}

        def scored(text: str, s: tuple[str, int, int], strict: bool) -> dict:
            key = pattern(text, *s, strict, shared.value)
            if key not in known:
                known[key] = model.probability(key) if model else 0.0
            return {"kind": s[0], "start": s[1], "end": s[2], "base": strict, "score": known[key]}

        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = [scored(text, s, True) for s in base]
                loose = loose_spans(text, base) if text else []
                spans += [x for x in (scored(text, s, False) for s in loose) if x["score"] >= sure]
                out.append(sorted(spans, key=lambda x: (KINDS.index(x["kind"]), x["start"])) if loose else spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=[id_col, "spans"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean, score: double>>")
