"""Language identification with error-correcting output codes.

Every language has a codeword of bits; every bit has a binary classifier over hashed character 2- and 3-grams. A
classifier is logistic: it starts from the log odds of the grams' mean frequency in the languages with bit 1 against those with
bit 0, over all training documents, and is then fitted, each bit for itself and with languages weighted equally, on a bounded
sample of distinct training texts (about ``sample_rows``, by a hash threshold for each language): a scale of the log odds, an offset and
corrections of the ``CORRECTED`` grams that tell languages apart most.

Decoding is loss-weighted: a language's loss is the mean over bits of log(1 + exp(-bit x margin)), each bit weighted by the share of
the language's training documents (all of them) that its classifier gets right, so bits that fail for a language count less
in its distance. The nearest codeword wins, ``score`` is its share in the softmax of the negated losses times the bits, and
``ambiguous`` flags a runner-up within ``gap``.

Tasks count with numpy, Spark sums: n-grams of each language in a first pass, hits of each language and bit in a second one. What
reaches the driver is languages x ``features`` numbers and the sample, whatever the corpus holds.

Edge cases: a text that is null or holds no letter is ``und`` with score 0; training
rows with a null language, null text or no letter teach nothing; without any training row
every text is ``und``; with one language all texts with letters get it; of equally near
codewords the first language in order wins and the text is ambiguous; very long texts are
counted whole; repeated rows count each time; an empty table gives no rows; other columns are
ignored, and kept ones named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import sliced, prepare

FEATURES = 1 << 14
#: Grams of one text overlap, so a text counts as this many independent grams at most.
EFFECTIVE_GRAMS = 48
#: Grams whose weights are corrected when a bit is fitted, steps of a fit, and how strongly it holds to the log odds.
CORRECTED, STEPS, HOLD = 1024, 120, 1e-2
#: Languages beyond this are refused: their counts would not fit the driver.
MAX_LANGUAGES = 1024
#: Columns of a prediction; a kept column of one of these names gives way.
ADDED = ("lang_pred", "score", "ambiguous")

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to itself for letters of the first plane, to 0 for all else; 65536 stands for higher planes."""
    if not _letters:
        t = np.zeros(0x10001, np.uint32)
        t[:0x10000] = [i if chr(i).isalpha() else 0 for i in range(0x10000)]
        t[0x10000] = 0x10000
        _letters.append(t)
    return _letters[0]


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """Hashed counts of a text's letter 2- and 3-grams, with word edges as letters."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letter_table()[np.minimum(codes, 0x10000)]
    if not c.any():
        return np.zeros(features, np.int64)
    shift = np.uint32(32 - features.bit_length() + 1)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    two = two[(c[:-1] | c[1:]) != 0]
    three = three[(c[1:-1] != 0)]
    grams = np.concatenate([two * np.uint32(0xC2B2AE35) >> shift, three * np.uint32(0x27D4EB2F) >> shift])
    return np.bincount(grams, minlength=features)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1: all splits up to 5 languages, else the best-spaced of random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        splits = [s for n in range(1, k) for s in combinations(range(k), n) if 0 in s]
        return np.array([[1.0 if i in s else -1.0 for s in splits] for i in range(k)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(k)))
    best, spread = None, -1.0
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], size=(k, bits))
        m = m[:, np.abs(m.sum(0)) < k]
        nearest = (m.shape[1] - (m @ m.T - 2 * m.shape[1] * np.eye(k)).max()) / 2 if m.shape[1] else -1
        if nearest > spread:
            best, spread = m, nearest
    return best


class CodedClassifiers:
    """The trained bits: languages, codewords, a weight table, what fitting has changed, and the weights of bits."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages))
        share = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * counts.shape[1])
        weights = []
        for bit in self.codes.T:
            yes, no = share[bit > 0], share[bit < 0]
            weights.append(np.log(yes.mean(0)) - np.log(no.mean(0)) if len(yes) and len(no) else np.zeros(counts.shape[1]))
        self.weights = np.array(weights).T.astype(np.float32)
        bits = self.codes.shape[1]
        # Grams whose log frequency differs most between languages, by how often they occur.
        spread = (np.log(share).std(0) * share.mean(0)) if len(share) > 1 else np.zeros(share.shape[1])
        self.telling = np.sort(np.argsort(-spread, kind="stable")[:CORRECTED])
        self.scale, self.offset = np.ones(bits), np.zeros(bits)
        self.corrected, self.change = self.telling[:0], np.zeros((0, bits), np.float32)
        self.importance = np.full(self.codes.shape, 1 / bits)

    def _parts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log odds of at most EFFECTIVE_GRAMS grams, shares of the corrected grams times that number, and it as a share of the most."""
        n = counts.sum(1, keepdims=True)
        seen = np.minimum(n, EFFECTIVE_GRAMS)
        return (counts @ self.weights) / np.maximum(n, 1) * seen, counts[:, self.corrected] / np.maximum(n, 1) * seen, seen / EFFECTIVE_GRAMS

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """What each bit's classifier says of each row of counts."""
        odds, some, certain = self._parts(counts)
        return odds * self.scale + some @ self.change + certain * self.offset

    def fit(self, counts: np.ndarray, language: np.ndarray) -> None:
        """Fits each bit's classifier to the rows of counts and their languages' bits: the mean logistic loss, all languages
        weighing the same, plus HOLD times the squared change; by gradient steps with per-parameter rates (Adam)."""
        self.corrected, self.change = self.telling, np.zeros((len(self.telling), self.codes.shape[1]), np.float32)
        odds, some, certain = self._parts(counts)
        want = self.codes[language]
        weight = (1 / np.bincount(language, minlength=len(self.codes))[language])[:, None] / len(np.unique(language))
        held = [np.log(self.scale), self.offset.copy(), self.change.astype(float)]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in held]
        for step in range(1, STEPS + 1):
            scale = np.exp(held[0])
            margin = odds * scale + some @ held[2] + certain * held[1]
            slope = -weight * want / (1 + np.exp(np.clip(want * margin, -50, 50)))
            slopes = [(slope * odds).sum(0) * scale + HOLD * held[0], (slope * certain).sum(0) + HOLD * held[1], some.T @ slope + HOLD * held[2]]
            for x, g, (m, v) in zip(held, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.scale, self.offset, self.change = np.exp(held[0]), held[1], held[2].astype(np.float32)

    def weigh(self, hits: np.ndarray, totals: np.ndarray) -> None:
        """Weights of bits: the share of each language's documents that a bit's classifier gets right (with one hit and one miss
        added), divided by their sum over the bits."""
        right = (hits + 1) / (totals[:, None] + 2)
        self.importance = right / right.sum(1, keepdims=True)

    def decode(self, counts: np.ndarray, gap: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row of counts."""
        margins = self.margins(counts)
        loss = (np.logaddexp(0, -self.codes[None] * margins[:, None, :]) * self.importance[None]).sum(2) * self.codes.shape[1]
        order = np.sort(loss, 1)
        like = np.exp(order[:, :1] - loss)
        score = like.max(1) / like.sum(1)
        ambiguous = (order[:, 1] - order[:, 0] < gap) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return loss.argmin(1), score, ambiguous


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", features: int = FEATURES, sample_rows: int = 4096) -> CodedClassifiers | None:
    """Fits the classifiers on all rows with a language; None if there are none."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(docs[lang_col].cast("string").alias("l"), docs[text_col].cast("string").alias("t")).where("l IS NOT NULL AND t IS NOT NULL")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = gram_counts(text, features)
                if counts.any():
                    own = sums.setdefault(lang, np.zeros(features + 1, np.int64))
                    own[:features] += counts
                    own[features] += 1  # texts
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["l", "f", "n"])

    counted = rows.mapInArrow(task, "l string, f int, n bigint").groupBy("l", "f").agg(F.sum("n").alias("n"))
    # Packed by language before it travels: at most languages x features x 12 bytes reach the driver.
    packed = counted.groupBy("l").agg(F.collect_list(F.struct("f", "n")).alias("c")).select("l", F.col("c.f").alias("f"), F.col("c.n").alias("n"))
    found = packed.limit(MAX_LANGUAGES + 1).toArrow().sort_by("l")
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found.num_rows:
        return None
    counts = np.zeros((found.num_rows, features + 1))
    for k in range(found.num_rows):
        counts[k, found["f"][k].values.to_numpy()] = found["n"][k].values.to_numpy()
    languages = found["l"].to_pylist()
    model = CodedClassifiers(languages, counts[:, :features])
    if len(languages) > 1:
        model.fit(*_sampled(rows, languages, counts[:, features], features, sample_rows))
        model.weigh(*_hits(rows, model, features))
    return model


def _sampled(rows: DataFrame, languages: list[str], texts: np.ndarray, features: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts and languages of about ``sample_rows`` distinct texts, as many of each language where it has them."""
    each = max(4, sample_rows // len(languages))
    bound = F.lit(0).cast("long")
    for name, n in zip(languages, texts, strict=True):
        bound = F.when(F.col("l") == name, F.lit(int(min(1.0, each / n) * (1 << 30)))).otherwise(bound)
    drawn = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < bound).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [gram_counts(t, features) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(c) for c in made]
            f = pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32()))
            n = pa.array([c[x].astype(np.int32) for c, x in zip(made, at, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f, n], names=["l", "f", "n"])

    # Only grams travel: of a text at most ``features``. Copies were one text; twice the rows asked for are the most.
    got = drawn.mapInArrow(count, "l string, f array<int>, n array<int>").where("size(f) > 0").orderBy("l", F.hash("f", "n")).limit(2 * max(sample_rows, 4 * len(languages))).toArrow()
    out = np.zeros((got.num_rows, features), np.float32)
    for i in range(got.num_rows):
        out[i, got["f"][i].values.to_numpy()] = got["n"][i].values.to_numpy()
    place = {name: k for k, name in enumerate(languages)}
    return out, np.array([place[x] for x in got["l"].to_pylist()], int)


def _hits(rows: DataFrame, model: CodedClassifiers, features: int) -> tuple[np.ndarray, np.ndarray]:
    """For each language how many of its training texts each bit's classifier gets right, and how many there are."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = {name: k for k, name in enumerate(model.languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = np.zeros((len(m.languages), m.codes.shape[1] + 1), np.int64)
        for batch in sliced(batches):
            at = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], int)
            counts = np.array([gram_counts(t, features) for t in batch.column(1).to_pylist()], np.float32).reshape(len(at), -1)
            at[~counts.any(1)] = -1
            right = (m.margins(counts[at >= 0]) * m.codes[at[at >= 0]]) > 0
            np.add.at(sums, (at[at >= 0], slice(0, -1)), right)
            np.add.at(sums, (at[at >= 0], -1), 1)
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["l", "n"])

    told = rows.mapInArrow(task, "l int, n array<bigint>").select("l", F.posexplode("n").alias("bit", "n")).groupBy("l", "bit").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((len(model.languages), model.codes.shape[1] + 1))
    for r in told:  # languages x bits
        sums[r["l"], r["bit"]] = r["n"]
    return sums[:, :-1], sums[:, -1]


def predict(docs: DataFrame, model: CodedClassifiers | None, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``lang_pred``, ``score`` and ``ambiguous`` for every row."""
    prepare(docs.sparkSession)
    keep = {name: c for name, c in keep.items() if name not in ADDED}
    rows = docs.select(*(c.alias(f"_k{i}") for i, c in enumerate(keep.values())), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x bits numbers
    names, n = list(keep), len(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            texts = batch.column(n).to_pylist()
            lang, score, flag = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = [i for i, t in enumerate(texts) if t is not None] if m else []
            if at:
                best, s, a = m.decode(np.stack([gram_counts(texts[i], len(m.weights)) for i in at]).astype(np.float32))
                score[at], flag[at] = s, a
                for i, k in zip(at, best, strict=True):
                    lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(flag)], names=[*names, "lang_pred", "score", "ambiguous"])

    kinds = [f"`{name}` {rows.schema[f'_k{i}'].dataType.simpleString()}" for i, name in enumerate(keep)]
    return rows.mapInArrow(task, ", ".join([*kinds, "lang_pred string", "score double", "ambiguous boolean"]))
