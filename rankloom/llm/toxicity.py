"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts drawn from the whole corpus are the
unlabelled set. A linear classifier over the words of a text and their beginnings is
trained in numpy with the non-negative risk estimator (Kiryo et al., 2017):

    prior x R+(positives) + max(0, R-(unlabelled) - prior x R-(positives)),

where the prior is the toxic share of the labelled training rows. While the second
part is negative, the step runs against it, which keeps the classifier from
fitting the positives alone. The fit uses a bounded sample, documents with the smallest
hashes of their ids: about ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts. Tasks split them into words and work out
features and values; the driver gets numbers and fits. Scoring reads every whole text.

A word counts by its presence, a beginning of ``SHORTEST`` to ``LONGEST`` characters by
its share of the text's words: languages that inflect and compound mark a text by many
different words of one beginning, and by chance any long text holds one of them.

Edge cases: a null text is empty and scored by the bias alone; without positive
training rows all scores are 0; repeated labels of an id count once, toxic if any
says so; null labels and ids are ignored in training; repeated rows are scored alike, equal
texts have equal scores; very long texts are scored whole; an empty table gives no rows; other
columns are ignored, and a kept one named ``score`` gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import prepare, sliced, staged, staging

#: Texts of the sample, about; both bounds hold for the fit only: scoring reads every whole text.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 8000
#: A word or beginning becomes a feature if at least MIN_TEXTS positive texts of the sample
#: hold it and the means of its values over positive and unlabelled texts differ by MIN_Z
#: standard errors, taken from the unlabelled texts, so that a rare language's words count too.
MIN_TEXTS, MIN_Z = 3, 5.0
SHORTEST, LONGEST = 3, 8
#: Words whose features are remembered at a time.
REMEMBERED = 200_000
_words = re.compile(r"[^\W\d_]+").findall


def word_counts(text: str | None) -> Counter[str]:
    """Counts of the lower-cased words of a whole text."""
    return Counter(_words((text or "").lower()))


def parts(word: str) -> list[str]:
    """The word itself, closed by ``$``, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))]


class Features:
    """Numbered words and beginnings, and their values in a text."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {name: k for k, name in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def values(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features that a text holds, and their values."""
        known, held = self.known, {}
        for word, count in counts.items():
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = tuple(self.number[x] for x in parts(word) if x in self.number)
            for k in found:
                held[k] = held.get(k, 0) + count
        at = np.fromiter(held, np.int64, len(held))
        share = np.fromiter(held.values(), float, len(held)) / (sum(counts.values()) + 30)
        whole = np.fromiter((self.names[k].endswith("$") for k in held), bool, len(held))
        return at, np.where(whole, 1.0, np.log1p(50 * share))


Matrix = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def matrix(held: list[tuple[np.ndarray, np.ndarray]]) -> Matrix:
    """The values of texts, by cells: row, feature, value; and the number of texts."""
    none = [np.zeros(0, np.int64)], [np.zeros(0)]
    rows = np.repeat(np.arange(len(held)), [len(at) for at, _ in held])
    return rows, np.concatenate([at for at, _ in held] or none[0]), np.concatenate([x for _, x in held] or none[1]), len(held)


def _means(x: Matrix, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and mean square of each feature."""
    return tuple(np.bincount(x[1], weights=by, minlength=features) / max(x[3], 1) for by in (x[2], x[2] ** 2))


def telling(n: int, p: np.ndarray, m: int, u: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Features whose means over n positive and m unlabelled texts differ by MIN_Z standard errors."""
    spread = square - u**2 + 0.02 / (m + 1)
    return np.flatnonzero(np.abs(p - u) >= MIN_Z * np.sqrt(np.maximum(spread, 0) * (1 / n + 1 / m)))


def _of(x: Matrix, chosen: np.ndarray, features: int) -> Matrix:
    """The cells of the chosen features, numbered anew."""
    place = np.full(features, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[x[1]]
    return x[0][at >= 0], at[at >= 0], x[2][at >= 0], x[3]


def named(texts: Iterable[dict[str, int]]) -> list[str]:
    """Words and beginnings that at least MIN_TEXTS texts hold."""
    met = Counter(x for counts in texts for x in {x for word in counts for x in parts(word)})
    return sorted(x for x, n in met.items() if n >= MIN_TEXTS)


def risk_parts(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """prior x R+(positives), and R-(unlabelled) - prior x R-(positives), of logistic losses of scores."""
    return float(prior * np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def score_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step descends, by the scores of positives and of unlabelled texts: the sum of both
    parts of the risk; while the second is negative, that part alone, turned round."""
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    rest_p, rest_u = -prior * sp / len(gp), su / len(gu)
    if risk_parts(gp, gu, prior)[1] < 0:
        return -rest_p, -rest_u
    return prior * (sp - 1) / len(gp) + rest_p, rest_u


class NonNegativePU:
    """Linear scores over the values of ``features``; ``weights`` has one for each."""

    def __init__(self, names: list[str], positive: Matrix, unlabelled: Matrix, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 3e-4):
        chosen = telling(positive[3], _means(positive, len(names))[0], unlabelled[3], *_means(unlabelled, len(names)))
        self.features = Features([names[k] for k in chosen])
        wp, wu = _of(positive, chosen, len(names)), _of(unlabelled, chosen, len(names))
        w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            gp, gu = self._scores(wp, w) + b, self._scores(wu, w) + b
            by_p, by_u = score_slopes(gp, gu, prior)
            slope = self._slope(wp, by_p) + self._slope(wu, by_u)
            slope[:-1] += decay * w
            m = 0.9 * m + 0.1 * slope
            v = 0.999 * v + 0.001 * slope**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
        self.bias = b
        self.weights = w

    def _sums(self, x: Matrix, by_cell: np.ndarray) -> np.ndarray:
        return np.bincount(x[1], weights=by_cell, minlength=len(self.features.names))

    def _scores(self, x: Matrix, w: np.ndarray) -> np.ndarray:
        return np.bincount(x[0], weights=w[x[1]] * x[2], minlength=x[3])

    def _slope(self, x: Matrix, by_text: np.ndarray) -> np.ndarray:
        return np.append(self._sums(x, by_text[x[0]] * x[2]), by_text.sum())

    def score(self, text: str | None) -> float:
        at, x = self.features.values(word_counts(text))
        g = self.bias + float(self.weights[at] @ x)
        return float(1 / (1 + np.exp(-np.clip(g, -60, 60))))


def _drawn(ids: DataFrame, total: int, bound: int) -> DataFrame:
    """About ``bound`` of ``total`` ids, all if there are fewer: those with the smallest hashes, by a
    threshold, so no task gathers the candidates of others."""
    share = int(min(1.0, bound / max(total, 1)) * (1 << 30))
    return ids.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share)


def _picked(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """(i, t) of the documents in ``ids`` (bounded, so it is broadcast), one row an id, staged; at most twice ``bound``."""
    texts = docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t")).join(F.broadcast(ids), "i", "left_semi")
    return staged(texts.groupBy("i").agg(F.max("t").alias("t")).limit(2 * bound), "toxicity-sample")


def _names(texts: DataFrame) -> list[str]:
    """``named`` of sampled texts, counted by Spark: only names that enough texts hold reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            met = Counter(x for t in batch.column(0).to_pylist() for x in {x for word in word_counts(t) for x in parts(word)})
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["x", "n"])

    counted = texts.select("t").mapInArrow(task, "x string, n bigint").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS)
    return sorted(counted.select("x").toArrow()["x"].to_pylist())


#: Sums of values are taken as integers of this scale, so they don't depend on the order of tasks.
_SCALE = 1 << 30


def _told(texts: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many sampled texts there are, and mean and mean square of each feature's values: tasks and Spark add, the driver gets sums."""
    shared = texts.sparkSession.sparkContext.broadcast(Features(names))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, len(names)), np.int64), 0
        for batch in sliced(batches):
            for t in batch.column(0).to_pylist():
                at, x = shared.value.values(word_counts(t))
                sums[0, at] += np.rint(x * _SCALE).astype(np.int64)
                sums[1, at] += np.rint(x * x * _SCALE).astype(np.int64)
                n += 1
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *sums[0, used].tolist()], pa.int64()), pa.array([0, *sums[1, used].tolist()], pa.int64())], names=["k", "s", "q"])

    got = texts.select("t").mapInArrow(task, "k int, s bigint, q bigint").groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
    k, s, q = (got[c].to_numpy() for c in ("k", "s", "q"))
    n, out = int(s[k < 0].sum()), np.zeros((2, len(names)))
    out[:, k[k >= 0]] = np.stack([s, q])[:, k >= 0] / _SCALE / max(n, 1)
    return n, *out


def _values(texts: DataFrame, names: list[str]) -> Matrix:
    """The values of sampled texts, worked out in tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(Features(names))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = [shared.value.values(word_counts(t)) for t in batch.column(1).to_pylist()]
            at = pa.array([a.astype(np.int32) for a, _ in held], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), at, pa.array([x for _, x in held], pa.list_(pa.float64()))], names=["i", "at", "x"])

    got = texts.mapInArrow(task, "i string, at array<int>, x array<double>").orderBy("i").toArrow()
    return matrix([(a.values.to_numpy().astype(np.int64), x.values.to_numpy()) for a, x in zip(got["at"], got["x"], strict=True)])


def train(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NonNegativePU | None:
    """Fits on rows of ``labels`` and ``docs`` for which ``training`` (over ``id_col``) holds."""
    prepare(docs.sparkSession)
    known = labels.where(training).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if not total["p"]:
        return None
    prior = min(max(total["p"] / total["n"], 1e-3), 0.9)
    toxic = _drawn(known.where("y = 1").select("i"), total["p"], MAX_POSITIVE)
    ids = docs.where(training).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"))
    drawn = _drawn(ids, ids.count(), MAX_UNLABELLED).distinct()
    with staging(docs.sparkSession):
        toxic_texts = _picked(docs, toxic, id_col, text_col, MAX_POSITIVE)
        some_texts = _picked(docs, drawn, id_col, text_col, MAX_UNLABELLED)
        names = _names(toxic_texts)
        (n, p, _), (m, u, square) = _told(toxic_texts, names), _told(some_texts, names)
        if not n or not m:
            return None
        names = [names[k] for k in telling(n, p, m, u, square)]
        positive, unlabelled = _values(toxic_texts, names), _values(some_texts, names)
    return NonNegativePU(names, positive, unlabelled, prior)


def score(docs: DataFrame, model: NonNegativePU | None, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``score`` for every row."""
    prepare(docs.sparkSession)
    keep = {name: c for name, c in keep.items() if name != "score"}
    rows = docs.select(*(c.alias(f"_k{i}") for i, c in enumerate(keep.values())), F.col(text_col).cast("string").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of features of the bounded sample
    names, n = list(keep), len(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            scores = [m.score(t) if m else 0.0 for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], names=[*names, "score"])

    kinds = [f"`{name}` {rows.schema[f'_k{i}'].dataType.simpleString()}" for i, name in enumerate(keep)]
    return rows.mapInArrow(task, ", ".join([*kinds, "score double"]))
