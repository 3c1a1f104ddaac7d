import math
import random
import re
from collections import Counter

import numpy as np

from rankloom.llm.private_data import KINDS, SpanClassifier, base_spans, find_private_data, learned_cues, loose_spans, luhn

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    alphabet = list("a1b2.@+-() 4é%0\n") + ["4111111111111111", "1.2.3.4", "+1 (017) 555-7713", "x@y.z", "@@", "256.1.1.1.9"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == brute(text), text


def test_long_runs_are_quick():
    for text in ("7" * 200_000, "a" * 200_000 + " @", "a." * 100_000 + "@b", "1." * 100_000, "+1" * 50_000):
        base_spans(text)


def test_spans_of_a_table(spark):
    known = "call me: +1 (017) 555-7713, mail a.b@mail7.example.com, card 4111 1111 1111 1111, host 10.2.3.4"
    rows = [(i, known, "x") for i in range(40)] + [(50, None, "x"), (51, "", "x"), (52, "Version 2.0. of 1998", "x"), (None, known, "x"), (53, "phone: (415) 555-0134 or write jo.doe (at) mail7 (dot) example (dot) com", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_private_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.spans for r in got}
    assert by[50] == by[51] == by[52] == []
    assert [(s.kind, s.start, s.end) for s in by[None]] == brute(known)
    assert all(s.base for s in by[3])
    assert {s.kind for s in by[53]} == {"email", "phone"}
    assert find_private_data(docs.limit(0)).count() == 0


def test_spelled_addresses_in_every_writing():
    for span in ("ann at example dot com", "ann At example Dot com", "ann\tat\nexample\tdot com", "ann (AT) example.com", "ann[at]example [dot] co.uk", "a.b aT x dot y DOT de"):
        for text in (span, f"see {span}, then", "word " * 30 + span):
            assert [text[a:b] for kind, a, b in loose_spans(text, []) if kind == "email"] == [span]
    for text in ("meet me at home. Then dot the i", "at at at", "anecdote at noon", "ann (at) home"):
        assert not [s for s in loose_spans(text, []) if s[0] == "email"]
    loose_spans(" at " * 100_000 + "dot", [])


def test_estimation_against_a_plain_version():
    """Reliabilities and posteriors item by item, and a classifier at its optimum."""
    rng = random.Random(3)
    counts = {}
    for _ in range(400):
        key = (rng.choice((0, 3)), rng.choice((0, 1)), *(rng.choice((-1, 0, 1)) for _ in range(4)), rng.randrange(3))
        counts[key] = counts.get(key, 0) + 1
    m = SpanClassifier(counts, rounds=7)
    truth = {}
    for kind in (0, 3):
        items = [k for k, n in counts.items() if k[0] == kind for _ in range(n)]
        post = [(k[2] >= 0) / (1 + math.exp(-1.5 * sum(k[1:6]))) for k in items]
        for _ in range(7):
            prior = [(sum(1 - p for p in post) + 1) / (len(items) + 2), (sum(post) + 1) / (len(items) + 2)]
            table = []
            for j in range(5):
                table.append([])
                for y in (0, 1):
                    seen = {v: sum((p if y else 1 - p) for k, p in zip(items, post) if k[1 + j] == v) + (20 if v == 2 * y - 1 else 10 if v == 0 else 2) for v in (-1, 0, 1)}
                    table[j].append({v: x / sum(seen.values()) for v, x in seen.items()})
            both = [[prior[y] * math.prod(table[j][y][k[1 + j]] for j in range(5)) for y in (0, 1)] for k in items]
            post = [(k[2] >= 0) * b / (a + b) for k, (a, b) in zip(items, both)]
        truth |= dict(zip(items, post))
        got = m.reliability[KINDS[kind]]
        assert all(math.isclose(got[j][y][v + 1], table[j][y][v], rel_tol=1e-6) for j in range(5) for y in (0, 1) for v in (-1, 0, 1))

    def loss(w):
        total, n = 0.0, sum(counts.values())
        for k, c in counts.items():
            x = SpanClassifier._features(np.array([k]))[0] @ w
            total += c / n * (truth[k] * np.logaddexp(0, -x) + (1 - truth[k]) * np.logaddexp(0, x))
        return total + 0.5e-4 * (w @ w)

    best = loss(m.weights)
    for _ in range(40):
        assert loss(m.weights + np.array([rng.gauss(0, 0.05) for _ in m.weights])) > best


def test_reliable_labelers_get_more_weight():
    counts = {}
    rng = random.Random(0)
    for _ in range(3000):
        truth = rng.random() < 0.5
        vote = lambda p: 1 if (rng.random() < p) == truth else -1
        key = (0, 1 if truth and rng.random() < 0.9 else 0, vote(0.95), vote(0.9), vote(0.55), vote(0.8), 1)
        counts[key] = counts.get(key, 0) + 1
    m = SpanClassifier(counts)
    table = m.reliability["email"]
    assert table[1][1][2] > 0.9 > table[3][1][2]
    assert m.probability((0, 1, 1, 1, 0, 1, 1)) > 0.9 > 0.1 > m.probability((0, 0, -1, -1, 0, -1, 1))


LANGUAGES = {
    "en": ("the report of last week was sent to all members and then they met again in town", {"phone": "please call", "email": "write to", "card": "paid with card", "ip": "from host"}),
    "de": ("der bericht von gestern wurde an alle gesendet und danach traf man sich wieder dort", {"phone": "rufnummer lautet", "email": "schreib an", "card": "bezahlt mit karte", "ip": "vom rechner"}),
    "fr": ("le rapport de la semaine fut lu par tous et ensuite ils se virent encore en ville", {"phone": "appelez donc", "email": "envoyez vers", "card": "payé par carte", "ip": "depuis la machine"}),
    "es": ("el informe de ayer fue leído por todos y luego se vieron otra vez en la ciudad", {"phone": "llame ahora", "email": "escriba hacia", "card": "pagado con tarjeta", "ip": "desde el equipo"}),
}


def number(rng, digits, start=""):
    """Digits that pass the check, after ``start``."""
    body = start + "".join(str(rng.randrange(10)) for _ in range(digits - len(start) - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def planted(rng, lang):
    """(text, spans that are personal, by kind): plain ones, loose ones, and what only looks like them."""
    words, cues = LANGUAGES[lang]
    plain = lambda: " ".join(rng.sample(words.split(), 8))
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    name = f"{rng.choice('abcdefgh')}{rng.randrange(99)}.lee"
    at, dot = {"en": ("at", "dot"), "de": ("(ät)", "(punkt)"), "fr": ("arobase", "point"), "es": ("[arroba]", "[punto]")}[lang]
    card = number(rng, 16, "4")
    loose = {
        "phone": {"en": f"({rng.randrange(200, 999)}) 555-{d(4)}", "de": f"0{rng.randrange(20, 99)} / {d(3)} {d(4)}", "fr": f"0{rng.randrange(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", "es": f"6{d(2)} {d(3)} {d(3)}"}[lang],
        "email": f"{name} {at} mail{rng.randrange(9)} {dot} example {dot} org",
        "card": rng.choice([number(rng, 15, "37"), number(rng, 14, "36")]),
    }
    base = {"phone": f"+{rng.choice(['49 30', '33 1', '34 91', '1 212'])} {d(3)} {d(4)}", "email": f"{name}@mail{rng.randrange(9)}.example.com", "card": card, "ip": f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(1, 255)}"}
    wrong = str((int(card) + rng.randrange(1, 9)) % 10**16).zfill(16)
    decoys = [f"2021-0{rng.randrange(1, 9)}-{rng.randrange(10, 28)} 12:30", wrong if not luhn(wrong) else "0", f"version {rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(9)}", f"978-3-16-{d(6)}-0", f"{d(3)}-{d(4)}-{d(2)}", f"meet at the dot of {rng.randrange(9)}", f"isbn 0-{d(3)}-{d(5)}-1", f"{rng.randrange(100, 999)} {d(3)}"]
    text, spans = plain(), []

    def put(piece, kind=None, cue=""):
        nonlocal text
        text += f" {cue} " if cue else " "
        if kind:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece + ". " + plain()

    for kind in rng.sample(KINDS, 2):
        put(base[kind], kind, cues[kind] if rng.random() < 0.8 else "")
    if rng.random() < 0.5:
        kind = rng.choice(("phone", "email", "card"))
        put(loose[kind], kind, cues[kind] if rng.random() < 0.9 else "")
    if rng.random() < 0.2:
        text += " "
        two = number(rng, 16, "5"), number(rng, 16, "4")
        spans += [("card", len(text), len(text) + 16), ("card", len(text) + 17, len(text) + 33)]
        text += " ".join(two) + " " + plain()
    put(rng.choice(decoys))
    return text, spans


def test_held_out_spans_by_kind(spark):
    """Planted personal data in four languages: weighed on one half of the rows, found in the other; base spans stay."""
    rng = random.Random(11)
    rows = [(i, *planted(rng, rng.choice(sorted(LANGUAGES)))) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = find_private_data(docs.where("doc_id % 2 = 1"), learn_from=docs.where("doc_id % 2 = 0"))
    found = {r.doc_id: {(s.kind, s.start, s.end): s.base for s in r.spans} for r in got.collect()}
    hits, misses, extras = Counter(), Counter(), Counter()
    for i, text, spans in rows:
        if i % 2:
            base = set(base_spans(text))
            assert base == {s for s, b in found[i].items() if b}
            for s in spans:
                (misses if s not in found[i] else hits)[s[0] + (" base" if s in base else "")] += 1
            extras.update(s[0] for s in found[i] if s not in spans and s not in base)
    told = {k: (hits[k], misses[k], extras[k]) for k in (*KINDS, *(f"{k} base" for k in KINDS))}
    print(told)
    for kind in ("phone", "email", "card"):
        assert hits[kind] > 40
        assert hits[kind] / (hits[kind] + misses[kind]) > 0.85, told
        assert hits[kind] / (hits[kind] + extras[kind]) > 0.95, told
    # The words that the languages use before their numbers are learned.
    assert cues_of(spark, docs, "card") >= {"karte", "carte", "tarjeta"} and cues_of(spark, docs, "phone") >= {"rufnummer", "appelez", "llame"}


def cues_of(spark, docs, kind):
    return {w for w, v in learned_cues(docs).learned[kind].items() if v > 0}


def test_numbers_in_runs_and_national_ones():
    two = "7536784127813050 4845168114407329"
    assert base_spans(two) == [] and loose_spans(two, []) == [("card", 0, 16), ("card", 17, 33)]
    assert loose_spans("4111 1111 1111 1111 9999", [])[:1] == [("card", 0, 19)]
    behind = "+1 (826) 555-4081 190.137.223.204"
    assert [s for s in loose_spans(behind, base_spans(behind)) if s[0] == "phone"] == [("phone", 0, 17)]
    for span in ("(415) 555-0134", "030 / 1234567", "0049 30 123 4567", "01 23 45 67 89", "912 34 56 78", "612 345 678", "089-123-45-67"):
        assert [text[a:b] for text in (f"x {span}, y",) for kind, a, b in loose_spans(text, []) if kind == "phone"] == [span]
    for text in ("12-345", "2021-03-04 12:30", "1234567890", "0.123.456", "978-3-16-148410-0", "a01 23 45 67 89", "3.14 159 265"):
        assert not [s for s in loose_spans(text, []) if s[0] == "phone"], text
    long = "a [arroba] b" + " [punto] c" * 40
    assert loose_spans(long, []) == [("email", 0, len(long))]
    for text in ("1 " * 200_000, "0" * 300_000, "01 23 " * 50_000, "a at b dot " * 20_000, "1234 " * 60_000):
        loose_spans(text, [])
