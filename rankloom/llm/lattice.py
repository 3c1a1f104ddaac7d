"""Document likelihood over all subword segmentations of an existing vocabulary.

A text is its words (split at white space, A to Z lower-cased) and one end. A word is
spelled by the vocabulary's pieces, its first piece carrying the word mark, with single
bytes as a fallback, so every text has a probability. The forward recursion in log space sums
over all segmentations, and a text's ``score`` is the sum of its words' marginals and its
end. Piece weights sum to one, so texts' probabilities sum to at most one.

Piece weights start from the vocabulary's own scores. A vocabulary of byte pairs has ranks for
scores and not log probabilities; a rank r counts as 1 / (r + 2.7). One round of
expectation-maximisation over all training words, by their counts, then learns the weights
from the corpus through the same lattice: expected uses of each piece over all segmentations.

``mixed_score`` is a second figure beside it: each word's marginal mixed with the word's own
training frequency, the share of the marginal being that of training tokens seen once.

As Spark: tasks count their words with a hash table, Spark sums the counts of all
documents, lattice scores are computed once for each distinct word, and only the
``frequent`` most common words (a bounded table) are sent to the tasks that score
documents; the occurrences of all other words are joined to the word table by word and
summed by document. Frequent words thus never meet in one task.

Edge cases: a null text is empty, its only token is the end; null and repeated ids are
kept, each row is scored on its own; without training rows all counts are 0 and the
vocabulary's weights stay as they are; very long words and texts are scored whole, in
linear time; repeated words count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import sliced, prepare, staged

MARK = "▁".encode()
LN10 = log(10.0)
#: In place of a log weight: the beginning of a piece that is no piece itself.
NO_PIECE = 1.0
#: Bytes of a marked word whose probability stays far from the smallest double: a byte weighs over 1e-15 whatever
#: the corpus holds (0.1 of less than 1e14 uses).
LINEAR_BYTES = 20
#: Words sent to every scoring task; all others are joined.
FREQUENT = 150_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 400_000


def words(text: str | None) -> list[bytes]:
    """Lower-cases A to Z and splits at [\\x20\\x09-\\x0D], as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class PieceLattice:
    """Log weights of the pieces, as bytes, and of the single bytes."""

    def __init__(self, weights: dict[bytes, float], single: np.ndarray, end: float):
        self.weights, self.single, self.end = weights, single.tolist(), end
        # Every beginning of a piece is listed, so a search for the pieces at a place ends at the first miss.
        beginnings = {p[:k] for p in weights for k in range(1, len(p))}
        self.known = dict.fromkeys(beginnings, NO_PIECE) | weights
        self.chances = dict.fromkeys(beginnings, 0.0) | {p: exp(x) for p, x in weights.items()}
        self.single_chances = [exp(x) for x in self.single]

    @classmethod
    def of_model(cls, path: str) -> PieceLattice:
        """The vocabulary of a model file. Its scores are ranks; by Zipf's law a rank r weighs 1 / (r + 2.7)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        top = max(sp.get_score(i) for i in normal)
        raw = {sp.id_to_piece(i).encode(): 1 / (top - sp.get_score(i) + 2.7) for i in normal}
        return cls.of_counts({p: w * 1e6 for p, w in raw.items()}, np.full(256, 10.0), 1e4)

    @classmethod
    def of_counts(cls, counts: dict[bytes, float], single: np.ndarray, end: float) -> PieceLattice:
        total = log(sum(counts.values()) + float(single.sum()) + end)
        return cls({p: log(c) - total for p, c in counts.items()}, np.log(single) - total, log(end) - total)

    def arcs(self, w: bytes) -> list[list[tuple[int, float, bytes | None]]]:
        """For each end position the (start, log weight, piece) of the pieces that end there; None is a single byte."""
        n = len(w)
        into: list[list] = [[] for _ in range(n + 1)]
        get, single = self.known.get, self.single
        for i in range(n):
            into[i + 1].append((i, single[w[i]], None))
            for j in range(i + 1, n + 1):
                x = get(w[i:j])
                if x is None:
                    break
                if x < NO_PIECE:
                    into[j].append((i, x, w[i:j]))
        return into

    def marginal(self, word: bytes) -> float:
        """Natural log of the sum over all segmentations: the forward recursion."""
        w = MARK + word
        n, get, single = len(w), self.known.get, self.single
        into: list[list[float]] = [[] for _ in range(n + 1)]
        at = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                top = max(terms)
                at = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
            into[i + 1].append(at + single[w[i]])
            for j in range(i + 1, n + 1):
                x = get(w[i:j])
                if x is None:
                    break
                if x < NO_PIECE:
                    into[j].append(at + x)
        terms = into[n]
        top = max(terms)
        return top + log(sum([exp(t - top) for t in terms]))

    def expected(self, word: bytes, count: float, into_counts: dict, into_single: list) -> None:
        """Adds the expected uses of each piece in ``count`` such words (forward and backward).

        Probabilities of words up to LINEAR_BYTES can't underflow and are multiplied as they are; longer words go in log space.
        """
        w = MARK + word
        n = len(w)
        if n > LINEAR_BYTES:
            return self._expected_long(w, count, into_counts, into_single)
        get, single, uses = self.chances.get, self.single_chances, into_counts.get
        fore, back, arcs = [1.0] + [0.0] * n, [0.0] * (n + 1), []
        for i in range(n):
            at, b = fore[i], w[i]
            x = single[b]
            fore[i + 1] += at * x
            arcs.append((i, i + 1, x, None))
            for j in range(i + 1, n + 1):
                x = get(w[i:j])
                if x is None:
                    break
                if x:
                    fore[j] += at * x
                    arcs.append((i, j, x, w[i:j]))
        back[n] = count / fore[n]
        for i, j, x, piece in reversed(arcs):
            x *= back[j]
            back[i] += x
            if piece is None:
                into_single[w[i]] += fore[i] * x
            else:
                into_counts[piece] = uses(piece, 0.0) + fore[i] * x

    def _expected_long(self, w: bytes, count: float, into_counts: dict, into_single: list) -> None:
        arcs = self.arcs(w)
        n = len(w)
        fore, back = [0.0] * (n + 1), [-1e300] * (n + 1)
        for j in range(1, n + 1):
            terms = [fore[i] + x for i, x, _ in arcs[j]]
            top = max(terms)
            fore[j] = top + log(sum([exp(t - top) for t in terms]))
        back[n] = 0.0
        for j in range(n, 0, -1):
            for i, x, piece in arcs[j]:
                v = back[j] + x
                a, b = (back[i], v) if back[i] > v else (v, back[i])
                back[i] = a + log(1.0 + exp(b - a)) if a - b < 40 else a
                p = count * exp(fore[i] + x + back[j] - fore[n])
                if piece is None:
                    into_single[w[i]] += p
                else:
                    into_counts[piece] = into_counts.get(piece, 0.0) + p


def count_words(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """``word`` (binary) and ``c``, its uses in training rows, for every word of any row; staged."""
    rows = docs.select(training.alias("k"), docs[text_col].cast("string").alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in sliced(batches):
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if train:
                    seen.update(words(text))
                else:
                    for w in words(text):
                        seen.setdefault(w, 0)
            if len(seen) > HELD_WORDS:
                yield out()
                seen.clear()
        yield out()

    return staged(rows.mapInArrow(task, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "lattice-words")


def reestimated(lattice: PieceLattice, counts: DataFrame, end: float) -> PieceLattice:
    """One round of expectation-maximisation on all training words by their counts; at most a row for each piece comes back from a task."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)  # the vocabulary file's size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pieces: dict[bytes, float] = {}
        single = [0.0] * 256
        for batch in sliced(batches):
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                model.expected(w, c, pieces, single)
        used = [b for b in range(256) if single[b]]
        keys = [*pieces, *(bytes([0, b]) for b in used)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([*pieces.values(), *(single[b] for b in used)], pa.float64())], names=["p", "n"])

    rows = counts.where("c > 0").select("word", "c").mapInArrow(task, "p binary, n double").groupBy("p").agg(F.sum("n").alias("n")).collect()
    found, single = dict.fromkeys(lattice.weights, 0.01), np.full(256, 0.1)
    for r in rows:
        p = bytes(r["p"])
        if len(p) == 2 and p[0] == 0:  # no piece starts with a zero byte
            single[p[1]] += r["n"]
        else:
            found[p] += r["n"]
    return PieceLattice.of_counts(found, single, end)


def _frequent(scored: DataFrame) -> pa.Table:
    """The most frequent words, at most ``FREQUENT``: all whose count reaches a threshold taken from a
    histogram of counts (16 bins an octave), so nothing is sorted or gathered to find them."""
    level = F.when(F.col("c") > 0, F.floor(F.log2("c") * 16)).otherwise(F.lit(-1)).cast("int")
    histogram = scored.groupBy(level.alias("bin")).count().collect()
    taken, least = 0, None
    for r in sorted(histogram, key=lambda r: -r["bin"]):
        taken += r["count"]
        if taken > FREQUENT:
            break
        least = r["bin"]
    return scored.where(F.lit(False) if least is None else level >= least).toArrow()


def score_documents(docs: DataFrame, training: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``training``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one word frequencies), ``score`` (the lattice) and
    ``mixed_score``, all log10."""
    spark = docs.sparkSession
    prepare(spark)
    counts = count_words(docs, training, text_col)
    ends = docs.where(training).count()
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    total, distinct = stats["n"] + ends, stats["v"] + (1 if ends else 0)
    lattice = PieceLattice.of_model(model_path)
    if ends:
        lattice = reestimated(lattice, counts, float(ends))
    new = min(0.5, max(0.001, stats["once"] / total)) if total else 1.0
    shared = spark.sparkContext.broadcast(lattice)

    def logs(c, marginal) -> np.ndarray:
        """log10 of the base, the lattice and the mixture."""
        own = (1 - new) * c / total if total else 0.0 * c
        mixed = np.logaddexp(np.log(np.maximum(own, 1e-300)) + np.where(c > 0, 0.0, -1e300), np.log(new) + marginal)
        return np.stack([np.log10((c + 1.0) / (total + distinct + 1)), marginal / LN10, mixed / LN10], -1)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marginal = shared.value.marginal
        for batch in batches:
            found = logs(batch.column(1).to_numpy(zero_copy_only=False), np.array([marginal(w) for w in batch.column(0).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, np.ascontiguousarray(found.T))], names=["word", "c", "base", "own", "mixed"])

    scored = staged(counts.select("word", "c").mapInArrow(marginals, "word binary, c bigint, base double, own double, mixed double"), "lattice-scored")
    common = _frequent(scored)
    place = {w: k for k, w in enumerate(common["word"].to_pylist())}
    columns = np.stack([common[x].to_numpy() for x in ("base", "own", "mixed")] + [(common["c"].to_numpy() > 0).astype(float)], 1)
    of_end = [float(x) for x in logs(np.float64(ends), np.float64(lattice.end))]
    frequent = spark.sparkContext.broadcast((place, columns))
    rows = docs.select(docs[id_col].alias("_id"), training.alias("_k"), docs[text_col].cast("string").alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums of its end and frequent words, then one for each other word of it."""
        place, columns = frequent.value
        row = TaskContext.get().partitionId() << 40
        kinds = None
        for batch in sliced(batches):
            kinds = kinds or (pa.int64(), pa.binary(), pa.int64(), batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            out: list[list] = [[] for _ in kinds]
            for doc_id, train, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = Counter(words(text))
                at, uses, rare = [], [], []
                for w, n in seen.items():
                    k = place.get(w)
                    if k is None:
                        rare.append((w, n))
                    else:
                        at.append(k)
                        uses.append(n)
                sums = np.array(uses, float) @ columns[at] if at else np.zeros(4)
                # A blank never is in a word: this key matches no word and is the document's own.
                first = (row, b" %d" % row, 0, doc_id, bool(train), sum(seen.values()) + 1, int(sums[3]) + (1 if ends else 0), *(float(a) + b for a, b in zip(sums, of_end, strict=False)))
                for col, x in zip(out, first, strict=True):
                    col.append(x)
                out[0] += [row] * len(rare)
                out[1] += [w for w, _ in rare]
                out[2] += [n for _, n in rare]
                for col in out[3:]:
                    col += [None] * len(rare)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["row", "word", "n", "id", "train", "tokens", "known", "b", "s", "m"])

    parts = rows.mapInArrow(partial, f"row bigint, word binary, n bigint, id {kind}, train boolean, tokens bigint, known bigint, b double, s double, m double")
    met = parts.join(scored.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    summed = lambda own, rare: F.sum(F.coalesce(own, F.col("n") * F.col(rare)))
    sums = met.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("train").alias("train"),
        F.max("tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)))).alias("n_known"),
        summed("b", "base").alias("base_score"),
        summed("s", "own").alias("score"),
        summed("m", "mixed").alias("mixed_score"),
    )
    return sums.select(F.col("id").alias(id_col), F.col("train").alias("training"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "mixed_score")
