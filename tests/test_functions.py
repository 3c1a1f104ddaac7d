"""Truth tables of the column functions."""

import math

import numpy as np
import random
import time

import pytest
from pyspark.sql import functions as F

from rankloom.operators import features
from rankloom.operators.dictionary import found_terms
from rankloom.operators.lines import rebuilt_texts
from rankloom.functions import json_repair, scoring, text, vectors
from rankloom.functions.education import education_entries
from rankloom.functions.embedding import END_SHARE, END_WEIGHT, FNV_SEEDS, Features, HEAD_STEP, HEADS, PAIR_WEIGHT, PART_WEIGHT, STOP_WORDS, TOP_SHARE, TOP_WEIGHT, _words, embed, embed_many, fnv1a
from rankloom.functions.layout import SHOWN, STORED, Layout, combined_pages, rebuilt


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]



@pytest.mark.parametrize(
    ("low", "high", "years", "score"),
    [(2, 4, 2, 100), (2, 4, 3, 100), (2, 4, 4, 100), (2, 4, 1, 37.5), (2, 4, 0, 0), (2, 4, 5, 98), (2, 4, 10, 90), (2, 4, None, 50), (3, None, 3, 90), (3, None, 5, 100), (3, None, 1.5, 35), (None, None, 5, 100), (0, 0, 5, 100), (None, None, None, 100), (2, 4, float("nan"), 50), (2, 4, -1, 50), (None, 4, 6, 88), (None, 4, 40, 70), (5, 3, 5, 90)],
)
def test_experience(spark, low, high, years, score):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, scoring.match_experience(lit(low), lit(high), lit(years))) == pytest.approx(score)


@pytest.mark.parametrize(("parts", "overall"), [((100, 100, 100, 100), 100), ((80, 60, 90, 70), 75.5)])
def test_final_score(spark, parts, overall):
    assert one(spark, scoring.final_score(*(F.lit(float(x)) for x in parts)))["overall"] == pytest.approx(overall)


def test_scores_of_models(spark):
    assert one(spark, scoring.llm_fallback_score(F.lit(0.0))) == 25
    assert one(spark, scoring.llm_fallback_score(F.lit(100.0))) == 95
    assert one(spark, scoring.deterministic_score(F.lit(50.0), F.lit(100.0))) == 70
    assert [one(spark, scoring.hardware_tier(F.lit(x))) for x in (4, 16, 32)] == ["fast", "balanced", "quality"]


def test_skills(spark):
    skill = lambda s, i: F.struct(F.lit(s).alias("skill"), F.lit(i).alias("importance"))
    wanted = F.array(skill("Rust ", "required"), skill("React Native", "required"), skill("SQL", "preferred"), skill("Go", "nice-to-have"))
    got = one(spark, scoring.match_skills(wanted, F.array(F.lit(" rust"), F.lit("React"), F.lit("mysql"))))
    assert got["score"] == pytest.approx(100 * (1 + 0.6 + 0.5) / 3)
    assert [s["skill"] for s in got["matched"]] == ["Rust ", "React Native", "SQL"]
    assert [s["skill"] for s in got["missing"]] == ["Go"]
    none = F.array().cast("array<struct<skill: string, importance: string>>")
    assert one(spark, scoring.match_skills(none, F.array(F.lit("x"))))["score"] == 100
    assert one(spark, scoring.match_skills(wanted, F.array(F.lit(""))))["score"] == pytest.approx(100 * (0.6 * 2 + 0.5 * 2) / 3)


@pytest.mark.parametrize(("cosine", "low", "high"), [(1.0, 100, 100), (-1.0, 0, 0), (0.0, 50, 50), (float("nan"), 50, 50), (0.6, 50, 100), (-0.4, 0, 50)])
def test_semantic_score(spark, cosine, low, high):
    assert low <= one(spark, vectors.semantic_score(F.lit(cosine))) <= high


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, vectors.cosine_similarity(v(1, 2), v(1, 2))) == pytest.approx(1)
    assert one(spark, vectors.cosine_similarity(v(1, 0), v(0, 1))) == pytest.approx(0)
    assert one(spark, vectors.cosine_similarity(v(1, 1), v(-1, -1))) == pytest.approx(-1)
    assert one(spark, vectors.cosine_similarity(v(1), v(1, 2))) == 0
    assert one(spark, vectors.cosine_similarity(v(0, 0), v(1, 2))) == 0
    assert one(spark, vectors.normalize_l2(v(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalize_l2(v(0, 0))) == [0, 0]
    assert one(spark, vectors.mean_pooled(F.array(v(1, 0), v(0, 1)), 2)) == pytest.approx([math.sqrt(0.5)] * 2)
    assert one(spark, vectors.semantic_score_of_texts(F.lit(" "), F.lit("x"), F.lit(1.0))) == 50
    six = [0.5, -1.25, 3.0, 0.0, 2.5, 1e3]
    assert one(spark, vectors.decode_vector(vectors.encode_vector(v(*six)))) == six
    with pytest.raises(Exception, match="multiple of 4"):
        one(spark, vectors.decode_vector(F.lit(bytearray(b"abc"))))


PROFILE = "Built payment services in Rust and Python with PostgreSQL, Docker and Kubernetes on AWS."


def plain_fnv(key, seed):
    for byte in key:
        seed = (seed ^ byte) * 16777619 % 2**32
    return seed


def line_features(line: str) -> list[tuple[str, float]]:
    """Features of one line in reading order, with their weight in a line of weight 1."""
    words = [w for w in _words(line.lower()) if len(w.encode()) > 1 and w not in STOP_WORDS]
    out = []
    for w in words:
        out.append((w, 1.0))
        if len(w.encode()) >= 4:
            out += [("#" + w[i : i + n], PART_WEIGHT) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out + [(f"{a}_{b}", PAIR_WEIGHT) for a, b in zip(words, words[1:], strict=False)]


def plain_embed(text, dim=384) -> np.ndarray:
    """The unit vector of a text; zeros if it has no feature."""
    lines = [s for s in (x.strip() for x in (text or "").strip().split("\n")) if s]
    vector = np.zeros(dim, np.float32)
    place: dict[str, int] = {}
    ids, weights = [], []
    for at, line in enumerate(lines):
        share = np.float32(at) / np.float32(len(lines))
        weight = np.float32(TOP_WEIGHT if share < TOP_SHARE else END_WEIGHT if share > END_SHARE else 1.0)
        for feature, w in line_features(line):
            ids.append(place.setdefault(feature, len(place)))
            weights.append(np.float32(w) * weight)
    if not place:
        return vector
    tf = np.zeros(len(place), np.float32)
    np.add.at(tf, np.array(ids), np.array(weights, np.float32))
    keys = [f.encode() for f in place]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))  # float sums depend on order: bytes, ascending
    keys, tf = [keys[i] for i in order], tf[order]
    scaled = np.float32(1) + np.log(tf.astype(float)).astype(np.float32)
    a, b = (np.array([plain_fnv(k, s) for k in keys], np.uint32)[:, None] for s in FNV_SEEDS)
    head = np.arange(HEADS, dtype=np.uint32)[None]
    seed = (a + head * np.uint32(HEAD_STEP)) ^ (b * (head + np.uint32(1)))
    sign = np.where((seed >> np.uint32(16)) & np.uint32(1), np.float32(-1), np.float32(1))
    share = (np.float32(1) / (np.float32(1) + head.astype(np.float32) * np.float32(0.25)))[0]
    np.add.at(vector, (seed % np.uint32(dim)).ravel(), (sign * scaled[:, None] * share).ravel().astype(np.float32))
    vector /= 1 + np.abs(vector)
    length = np.sqrt((vector.astype(float) ** 2).sum())
    return vector if length <= 1e-12 else (vector / length).astype(np.float32)


def test_embedding_of_batches_is_that_of_single_texts():
    rng = np.random.default_rng(0)
    some = [f"w{k}" for k in range(90)] + ["c++", "node.js", "Éa", "the", "a", "x" * 300, "#tag", "日本語"]
    texts = [None, "", " \n ", "the a"] + ["\n".join(" ".join(rng.choice(some, rng.integers(0, 12))) for _ in range(rng.integers(1, 30))) for _ in range(300)]
    for dim in (384, 64):
        got = embed_many(texts, dim)
        for t, v in zip(texts, got, strict=True):
            assert v.dtype == np.float32 and (v == plain_embed(t, dim)).all(), t


def test_embedding():
    assert int(fnv1a([b"rust"], 0x811C9DC5)[0]) == 490716647
    for dim in (384, 768):
        assert np.linalg.norm(embed(PROFILE, dim)) == pytest.approx(1, abs=1e-4)
        assert embed(PROFILE, dim).shape == (dim,)
    assert not embed("").any() and not embed(None).any() and not embed("a the").any()
    assert (embed(PROFILE) == embed(PROFILE)).all()
    job = embed("We need an engineer for payment services: Rust, Python, PostgreSQL, Docker, Kubernetes, AWS.")
    other = embed("Pastry chef who bakes sourdough bread and cakes in a small village bakery.")
    assert embed(PROFILE) @ job > 0.25 > 0.1 > abs(embed(PROFILE) @ other)


def test_page_quality(spark):
    usable = "This page holds enough plain words for a reader to call it good text."
    for t, reason in ((None, "empty"), ("  ", "empty"), ("few words here", "word count"), ("a b c d e f g h i j", "character count"), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", "alphabetic"), ("\x01" * 40 + " words", "printable"), (usable, "meets")):
        q = one(spark, text.page_quality(F.lit(t)))
        assert reason in q["reason"] and q["is_usable"] == (reason == "meets")


def test_extraction(spark):
    raw = "Jane Q. Public\njane.public@mail.org | (415) 555-0134\n7+ years of experience with Rust, PostgreSQL and C++ now\nEDUCATION\nBachelor of Science, State University, 2014\nSKILLS\nx"
    assert one(spark, text.email(F.lit(raw))) == "jane.public@mail.org"
    assert one(spark, text.phone(F.lit(raw))).endswith("555-0134")
    assert one(spark, text.name_line(F.lit(raw))) == "Jane Q. Public"
    assert one(spark, text.experience_years(F.lit(raw))) == 7
    assert one(spark, text.experience_years(F.lit("55 years, then 5 years"))) is None
    assert one(spark, text.skills(F.lit(raw))) == ["Rust", "PostgreSQL"]
    assert one(spark, text.skills(F.lit("asp.net, C# "))) == [".NET"]
    assert one(spark, text.name_line(F.lit("x@y.z\n"))) == "x@y.z"
    assert one(spark, text.name_line(F.lit(""))) == "Candidate"
    assert education_entries(raw) == [{"degree": "Bachelor of Science", "institution": "State University", "year": "2014"}]


def test_education():
    noisy = "Ran a CMS on AWS systems\nBE quick\nMaster of Arts\nCity College 2011"
    assert education_entries(noisy) == [{"degree": "Master of Arts", "institution": "City College", "year": "2011"}]
    two = "Education:\nMBA\nNorth Business School, 2021\nB.Tech, Polytechnic of the Lake 2019\nProjects\nPhD"
    assert [(e["degree"], e["year"]) for e in education_entries(two)] == [("Master (MBA)", "2021"), ("B.Tech", "2019")]
    assert education_entries(None) == []


def test_layout(spark):
    assert rebuilt("One\nword\nper\nline.") == "One word per line."
    assert rebuilt("Intro SKILLS • Rust • Go 1. SQL") == "Intro\n\nSKILLS\n\n● Rust\n● Go\n● SQL"
    assert rebuilt("WORK EXPERIENCE Acme Corp Jan 2019 – Present Then more") == "WORK EXPERIENCE\n\nAcme Corp Jan 2019 – Present\nThen more"
    assert rebuilt("• did things Senior Engineer at Acme") == "● did things\n\nSenior Engineer at Acme"
    assert rebuilt("SKILLS & more") == "SKILLS & more"
    assert rebuilt("• SUMMARY") == "●\n\nSUMMARY\n"
    assert rebuilt("(12) x", SHOWN) == "● x" and rebuilt("(12) x") == "(12) x"
    assert rebuilt("• a Bachelor of Arts") == rebuilt("• a Bachelor of Arts", SHOWN) == "● a\n\nBachelor of Arts"
    assert rebuilt("• a PhD b") == "● a\n\nPhD b" and rebuilt("• a PhD b", SHOWN) == "● a PhD b"
    assert rebuilt(None) == rebuilt(" \n") == ""
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "b "), (1, 4, ""), (1, 5, "b"), (1, 6, "a"), (2, 1, None)], "doc_id int, page_number int, text string")
    assert dict(combined_pages(pages).collect()) == {1: "a\n\nb\n\na", 2: ""}


def test_json(spark):
    fence = 'Here:\n```json\n{"name": " Ann ", "email": "nope", "skills": [" Go ", ""], "experience_years": "5 years", "education": [{"degree": "", "institution": "X", "year": 2020}, {"degree": null, "institution": "Y"}],}\n``` bye {'
    c = one(spark, json_repair.candidate(F.lit(fence)))
    assert (c["name"], c["email"], c["skills"], c["experience_years"]) == ("Ann", None, ["Go"], 5.0)
    assert [tuple(e) for e in c["education"]] == [("Degree", "X", "2020")]
    assert one(spark, json_repair.candidate(F.lit("no json at all"))) is None
    full = '{"name": " Candidate ", "skills": [" Go ", ""], "experience_years": 2.5, "education": [{"degree": "", "institution": " X", "year": null}], "work_experience": []}'
    c = one(spark, json_repair.candidate(F.lit(full)))
    assert (c["name"], c["skills"], c["experience_years"], tuple(c["education"][0])) == (" Candidate ", [" Go ", ""], 2.5, ("", " X", None))
    for loose in (full.replace("2.5", '"2.5 years"'), full.replace("null", "2020"), full.replace('"work_experience": []', '"work_experience": null'), full.replace('"degree": "", ', "")):
        assert one(spark, json_repair.candidate(F.lit(loose)))["skills"] == ["Go"], loose
    a = lambda s: one(spark, json_repair.analysis(F.lit(s), F.lit(42.0)))
    assert a('{"llm_score": 150, "summary": " s ", "strengths": [" x", " "]}')["llm_score"] == 100
    assert a('{"llm_score": -25, "summary": "s"}')["llm_score"] == 0
    assert a('{"llm_score": "about 70.5 of 100", "summary": "s"}')["llm_score"] == 70.5
    assert a('{"llm_score": "-25", "summary": "s"}')["llm_score"] == 25
    assert a('{"llm_score": "7e1", "summary": "s"}')["llm_score"] == 7
    assert a('{"llm_score": 7e1, "summary": "s"}')["llm_score"] == 70
    assert a('{"summary": "s"}')["llm_score"] == 42
    assert a('{"llm_score": 5}') is None
    assert one(spark, json_repair.json_object(F.lit('x {"a": [1, 2, ], } y'))) == '{"a": [1, 2]}'


def test_merge(spark):
    answer = json_repair.candidate(F.lit('{"name": "Candidate", "skills": ["rust"], "experience_years": 0}'))
    own = json_repair.candidate(F.lit('{"name": "Ann Bee", "email": "a@b.co", "skills": ["Rust", "Go", "go"], "experience_years": 4, "education": [{"degree": "MBA", "institution": "X"}]}'))
    m = one(spark, json_repair.merged_candidate(answer, own))
    assert (m["name"], m["email"], m["skills"], m["experience_years"], len(m["education"])) == ("Ann Bee", "a@b.co", ["rust", "Go"], 4.0, 1)


def test_labels(spark):
    label = lambda lo, hi: one(spark, text.experience_label(F.lit(lo).cast("double"), F.lit(hi).cast("double")))
    assert [label(2, 4), label(3, None), label(None, 4), label(0, None), label(2.5, 2.5)] == ["2 - 4 years", "3+ years", "Up to 4 years", "Not specified", "2.5 years"]
    assert [one(spark, text.file_size_label(F.lit(n))) for n in (0, 1, 1024, 1536, 5 * 1024**3)] == ["0 Bytes", "1 Bytes", "1 KB", "1.5 KB", "5 GB"]
    left = {-1: "", 5: "< 10s", 40: "40s", 60: "About 1 min", 120: "About 2 mins", 95: "~1m 35s", 4500: "~1h 15m"}
    assert [one(spark, text.remaining_label(F.lit(n))) for n in left] == [f"{t} remaining" if t else "" for t in left.values()]
    assert one(spark, text.date_label(F.lit("2024-03-05").cast("timestamp"))) == "Mar 5, 2024"
    assert one(spark, F.size(text.chunks(F.array_repeat(F.lit("w"), 1000)))) == 3
    assert one(spark, text.char_ngrams(F.lit("héllo"), 3)) == ["hél", "éll", "llo"]
    assert one(spark, text.error_class(F.lit("This PDF is Scanned"))) == "scanned"


def test_linear_patterns_find_what_the_plain_ones_find(spark):
    """The same first match on random strings of the patterns' own characters, and long runs in time."""
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "@x.", "org", ".", "-", "%", " ", "12", "3.5", "+", "years", "YRS", " of ", "exp", "\n", "1.2.3 year", "9"]
    rows = [(n, "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for n in range(3000)]
    df = spark.createDataFrame(rows, "n int, t string")
    first = lambda pattern, group: F.nullif(F.regexp_extract("t", pattern, group), F.lit(""))
    assert df.where(~text.email(F.col("t")).eqNullSafe(first(text.EMAIL, 0)) | ~first(text.LINEAR_YEARS, 1).eqNullSafe(first(text.YEARS, 1))).count() == 0
    assert df.where(text.email(F.col("t")).isNotNull()).count() > 50 and df.where(first(text.LINEAR_YEARS, 1).isNotNull()).count() > 50
    for run, end in (("a", ""), ("a", "@"), ("1", ""), ("1", " yea"), ("1.", "")):
        began = time.perf_counter()
        long = spark.range(1).select(F.concat(F.repeat(F.lit(run), F.lit(1_000_000)), F.lit(end)).alias("t")).select(text.email(F.col("t")), text.experience_years(F.col("t"))).first()
        assert tuple(long) == (None, None) and time.perf_counter() - began < 10


def test_dictionary_of_any_size(spark):
    """Equal to the patterns tried one by one: signs at the edges, terms in terms, equal keys, nulls; 100,000 further terms change nothing."""
    rng = random.Random(4)
    pieces = [*text.SKILL_CATALOG, "c++x", "x.net", "c#y", "node", ".js", "-", " ", "/", ", ", "java script", "ci", "é", "_", "Über", "(x)"]
    rows = [(n % 150, "".join(rng.choice(pieces) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(12)))) for n in range(300)] + [(1, None), (None, "go rust"), (None, ""), (7, "Go " * 5000)]
    df = spark.createDataFrame(rows, "id int, text string")
    catalog = spark.createDataFrame(list(enumerate(text.SKILL_CATALOG)), "place int, term string")
    odd = spark.createDataFrame([(900, "(x)"), (901, "Über"), (902, " "), (903, None), (904, r"a\Eb"), (905, "++")], "place int, term string")
    low = F.lower("text")
    plain = F.array_compact(F.array(*(F.when(F.regexp_like(low, F.lit(text._edged(t))), F.lit(t)) for t in text.SKILL_CATALOG)))
    told = lambda d: sorted(map(str, d.collect()))
    want = told(df.select("id", plain.alias("terms")))
    assert told(df.select("id", text.skills(F.col("text")).alias("terms"))) == want
    assert told(found_terms(df, catalog)) == want
    more = spark.range(100_000).select((F.col("id") + 1000).cast("int").alias("place"), F.concat(F.lit("term "), "id", F.lit(" more")).alias("term"))
    assert told(found_terms(df, catalog.unionByName(more).unionByName(odd.where("place BETWEEN 902 AND 904")))) == want
    got = {r.terms[0] for r in found_terms(df, odd).collect() if r.terms}
    assert "Über" in got and found_terms(df, catalog.limit(0)).where("size(terms) > 0").count() == 0


def test_features_as_tables_are_the_embedder(spark):
    """Term weights, hashes and sparse vectors equal those that the embedder makes in Python."""
    some = ["", None, "the and of", "Rust c++ and C#\n.net  node.js\n\n  Senior Engineer\n2019", "é über Straße 日本語 ½ a_b x", "word " * 300 + "\nlast line of words", "\n".join(f"line {n} has word{n % 7}" for n in range(60))]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    weights = features.term_weights(df)
    held = Features(384)
    for i, t in enumerate(some):
        ids, uses = held.read(t)
        want = {}
        for n, w in zip(ids.tolist(), uses.tolist(), strict=True):
            want[held.keys[n].decode()] = want.get(held.keys[n].decode(), 0) + w
        got = {r.feature: r.tf for r in weights.where(F.col("doc_id") == i).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    keys = ["", "a", "é", "#wor", "日本", "x" * 50]
    row = spark.range(1).select(*(features.fnv1a(F.lit(k), s).alias(f"c{i}_{s}") for i, k in enumerate(keys) for s in FNV_SEEDS)).first()
    assert list(row) == [int(fnv1a([k.encode()], s)[0]) for k in keys for s in FNV_SEEDS]
    dense = {i: np.zeros(384) for i in range(len(some))}
    for r in features.sparse_vectors(weights).collect():
        dense[r.doc_id][r.place] = r.value
    for i, t in enumerate(some):
        assert np.abs(dense[i] - embed(t)).max() < 1e-5


@pytest.mark.parametrize("layout", [STORED, SHOWN, Layout(wide=("A B", "B C", "C D E"), single=("A", "E"))])
def test_layout_as_rows_is_the_layout(spark, layout):
    """Random texts of headers, bullets, roles, degrees and date ranges: token rows give what the texts give."""
    rng = random.Random(12)
    pieces = [*(w for h in layout.wide for w in h.split()), *layout.wide, *layout.single, *layout.role_starts[:3], *layout.role_ends[:3], *layout.degrees[:4], "of", *"•●*", "1.", "12)", "(3)", "(12)", "–", "-", "to", "Present", "Current", "2019", "2021", "1850", "word", "and", "&", "Skills:", "é", "ÄÖ", "日本", "²", "a", "Jan", "x"]
    some = [None, "", " \n", "• SUMMARY", "• Senior Engineer", "• •", "SKILLS", "a 2019 b – 2020 c d - Present"]
    some += ["".join(rng.choice(pieces) + rng.choice([" ", "\n", " \t ", "\x1c"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(some)) + [(3, "again 1. x")], "doc_id int, text string").repartition(5)
    got = sorted((r.doc_id, r.text) for r in rebuilt_texts(df, layout=layout).collect())
    assert got == sorted([(i, rebuilt(t, layout)) for i, t in enumerate(some)] + [(3, rebuilt("again 1. x", layout))])
    with pytest.raises(ValueError):
        rebuilt_texts(df, layout=Layout(wide=("A B", "B A")))


def test_streamed_features_are_the_tables(spark, monkeypatch):
    """the same features and vectors without a shuffle; texts without features have no row, small sendings change nothing."""
    monkeypatch.setattr(features, "SENT_FEATURES", 40)
    rng = random.Random(5)
    some = [None, "", "the of", "#wor word wor#d c++ ab_cd", "Über\nüber Straße 日本語 naïve\n\nend of text", *("\n".join(" ".join(rng.choice(["kafka", "spark", "foo", "foo1", "x", "the", "#foo", "données"]) for _ in range(rng.randrange(9))) for _ in range(6)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    weights = features.term_weights(df)
    want = {(r.doc_id, r.feature): r.tf for r in weights.collect()}
    streamed = features.weighted_features(df)
    assert "Exchange" not in streamed._jdf.queryExecution().executedPlan().toString()
    rows = streamed.collect()
    got = {(r.doc_id, f): tf for r in rows for f, tf in zip(r.features, r.tf, strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert all([f.encode() for f in r.features] == sorted(f.encode() for f in r.features) and r.hashes == [int(fnv1a([f.encode()], FNV_SEEDS[0])[0]) for f in r.features] for r in rows)
    dense = {(r.doc_id, r.place): r.value for r in features.sparse_vectors(weights).collect()}
    found = {(r.doc_id, r.place): r.value for r in features.vector_rows(df).collect()}
    assert found.keys() == dense.keys() and all(found[k] == pytest.approx(dense[k], abs=1e-9) for k in dense)


def test_names_of_a_batch_are_in_byte_order():
    """pairs take hashes and places from their words; the order is that of bytes."""
    rng = random.Random(6)
    held = Features(384)
    texts = ["\n".join(" ".join("".join(rng.choice("abcé#1") for _ in range(rng.randrange(1, 7))) for _ in range(12)) for _ in range(8)) for _ in range(50)]
    used, hashes, what = held.batch(texts)
    names = held.names(what)
    assert names == sorted(set(names)) and hashes[1].tolist() == fnv1a(names, FNV_SEEDS[1]).tolist()
    assert {names[i] for i in used[3][0]} == {held.keys[i] for i in held.read(texts[3])[0]}
