"""Removal of passages that earlier documents hold: windows of words, counted in super-k-mers.

A window is ``k`` consecutive words. Its minimiser is the least hash of the runs of ``M`` words in it, so
equal windows have equal minimisers, and neighbouring windows mostly share theirs: such windows travel as one packed
string (a super-k-mer) to the bucket of their minimiser. There the windows are sorted by hash and document, equal
hashes are compared as bytes, and every window that a document with a smaller id holds too
is reported. The reports go back to their documents by key, where the covered words are removed.

* Scatter: tasks take documents in chunks of about CHUNK bytes. Windows of a chunk are sorted first: what a smaller
  document of the chunk holds is settled there, and of the rest each document sends a window once. So a window of very
  many documents arrives once from every chunk at most. A chunk sends one compressed blob to a bucket, and its documents'
  keys once; reports name a document by its chunk and place.
* Buckets: as many as hold about BUCKET bytes of strings each. A minimiser that a sample of the documents (one in
  SAMPLED, by the hash of the text) shows to hold more than an eighth of a bucket is split: its windows travel one by
  one, dealt out by their own hash. The sample decides where windows meet, never whether.
* Documents that repeat a window within themselves get the report of its first place, and look up the others.

Shuffled are the strings (each word about three times, less what chunks settle), compressed, the reports, and
the texts once, to meet them. All counting is exact: hashes only bring together, bytes decide.

Edge cases: a null text has no words. A null id is greater than every other; rows of null id are ordered by a hash of their
texts, so of two different ones the second loses what they share. Rows of one id and text are one document, rows of one id and different texts
don't remove each other's words. A document of fewer than ``k`` words loses none. Other columns are ignored, or carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import prepare, sliced, staged, staging

#: Words of a minimiser.
M = 3
#: Bytes of text that a task sorts at a time, and bytes of packed strings that a bucket holds, about.
CHUNK, BUCKET = 8 << 20, 12 << 20
#: One document in so many is looked at for hot minimisers.
SAMPLED = 32
#: Minimisers that may be split, at most.
MOST_HOT = 1 << 20
#: Bytes whose hashes are worked out at a time, and blobs that are handed over at a time.
_BLOCK, BLOBS = 1 << 20, 64
_byte_values = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_byte_values[[10, 32]] = 0  # between words
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts, each joined by single spaces, and the hashes of their windows."""

    def __init__(self, texts: list[bytes], k: int):
        self.k = k
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        gap = np.concatenate([[True], (raw == 32) | (raw == 10), [True]])
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.ends = np.flatnonzero(~gap[:-1] & gap[1:])
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: The first word of each text, and the text of each word.
        self.first = np.searchsorted(self.starts, at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        n = len(self.starts)
        #: Where a window starts.
        self.windows = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        self.words = self._word_hashes(raw)
        self.hashes = self._runs(k)[self.windows] if len(self.windows) else np.zeros(0, np.uint64)

    def _word_hashes(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        if not len(out):
            return out
        powers = np.cumprod(np.full(int((self.ends - self.starts).max()) + 1, _STEP))
        # A block ends before the first word that starts beyond it.
        edges = np.unique([0, *np.searchsorted(self.starts, np.arange(_BLOCK, len(raw), _BLOCK)).tolist(), len(out)])
        for a, b in zip(edges, edges[1:], strict=False):
            low = self.starts[a]
            high = self.starts[b] if b < len(out) else len(raw)
            own = self.starts[a:b] - low
            place = np.arange(high - low) - np.repeat(own, np.diff([*own.tolist(), high - low]))
            values = _byte_values[raw[low:high]]
            out[a:b] = np.add.reduceat(values * powers[np.minimum(place, len(powers) - 1)], own)
        return _mixed(out + (self.ends - self.starts).astype(np.uint64))

    def _runs(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on (over text ends too)."""
        n = len(self.words) - length + 1
        total, power = np.zeros(n, np.uint64), 1
        for i in range(length):
            total += self.words[i : i + n] * np.uint64(power)
            power = power * 0xD6E8FEB86659FD93 % (1 << 64)
        return _mixed(total)

    def minimisers(self) -> np.ndarray:
        """The least hash of M words in each window."""
        if not len(self.windows):
            return np.zeros(0, np.uint64)
        m = min(M, self.k)
        runs = self._runs(m)
        n = len(self.words) - self.k + 1
        least = runs[:n].copy()
        for i in range(1, self.k - m + 1):
            np.minimum(least, runs[i : i + n], out=least)
        return least[self.windows]

    def packed(self, word: int, count: int) -> bytes:
        """The words of ``count`` windows from ``word`` on."""
        return self.data[self.starts[word] : self.ends[word + count + self.k - 2]]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at the words ``a`` (ascending) and those at ``b`` hold the same words."""
        out = np.ones(len(a), bool)
        if len(a):
            cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(a)], strict=True):
                if self.packed(a[low], high - low) != self.packed(b[low], high - low):
                    for i in range(low, high):
                        out[i] = self.packed(a[i], 1) == self.packed(b[i], 1)
        return out

    def leaders(self, rank: np.ndarray) -> np.ndarray:
        """For each window the place (in ``windows``) of the equal one that comes first, by the ``rank`` of its text and then as they stand."""
        own = rank[self.text[self.windows]]
        order = np.lexsort((own, self.hashes))
        fresh = np.concatenate([[True], np.diff(self.hashes[order]) != 0]) if len(order) else np.zeros(0, bool)
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else 0
        moved = np.flatnonzero(lead != np.arange(len(lead)))
        wrong = moved[~self.same(self.windows[moved], self.windows[lead[moved]])]
        if len(wrong):  # different windows of one hash: told apart by their bytes
            first: dict[bytes, int] = {}
            for i in order[np.isin(self.hashes[order], self.hashes[wrong])].tolist():
                lead[i] = first.setdefault(self.packed(self.windows[i], 1), i)
        return lead


def _spans(places: np.ndarray) -> np.ndarray:
    """Ascending window starts as rows (first, count)."""
    if not len(places):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
    return np.stack([places[low], high - low], 1).astype(np.int32)


def _equal(values: np.ndarray) -> list[tuple[int, int]]:
    """From where to where values are equal."""
    edges = [0, *(np.flatnonzero(np.diff(values) != 0) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:], strict=False)) if len(values) else []


#: A span that says: windows of this document repeat within it.
REPEATS = np.array([[-1, 0]], np.int32)
#: The key of a document: its id is null; its id, or a hash of its text; another hash of its text.
KEY = "unknown boolean, a long, b long"


def _ranks(unknown: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Dense order of documents: by id, those without one last, by ``a``."""
    order = np.lexsort((a, unknown))
    fresh = np.concatenate([[False], (np.diff(a[order]) != 0) | (np.diff(unknown[order].astype(int)) != 0)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh[: len(order)])
    return out


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """unknown, a, b and normalised text of documents of about ``size`` bytes, each document once, from (text, unknown, a, b)."""
    texts, keys, held = [], [], 0
    seen: set[tuple] = set()

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        unknown, a, b = zip(*keys, strict=True)
        return np.array(unknown, bool), np.array(a, np.int64), np.array(b, np.int64), texts

    for batch in sliced(batches):
        for text, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None or (own := tuple(key)) in seen:
                continue
            seen.add(own)
            keys.append(own)
            texts.append(b" ".join(text.split()))
            held += len(texts[-1])
            if held >= size:
                yield made()
                texts, keys, held, seen = [], [], 0, set()
    if texts:
        yield made()


def _sent(words: Words, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk settles: places (in ``windows``) that a smaller document holds; those to send; and the texts
    with windows that neither are settled nor sent, as they repeat within the text."""
    lead = words.leaders(rank)
    own = words.text[words.windows]
    gone = rank[own] > rank[own[lead]]
    # Of the others (of the smallest id), the first window of each text.
    left = np.flatnonzero(~gone)
    order = np.lexsort((left, own[left], lead[left]))
    key = np.stack([lead[left][order], own[left][order]])
    fresh = np.concatenate([[True], (np.diff(key) != 0).any(0)]) if len(left) else np.zeros(0, bool)
    return np.flatnonzero(gone), np.sort(left[order][fresh]), np.unique(own[left[order][~fresh]])


def _super_kmers(words: Words, sent: np.ndarray, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket, first word and number of windows of each packed string."""
    at, least = words.windows[sent], words.minimisers()[sent]
    alone = np.isin(least, hot)
    joined = (np.diff(at) == 1) & (np.diff(least) == 0) & ~alone[1:]
    low = np.flatnonzero(np.concatenate([[True], ~joined])) if len(at) else np.zeros(0, np.int64)
    count = np.diff([*low.tolist(), len(at)])
    route = np.where(alone[low], words.hashes[sent][low], _mixed(least[low]))
    return (route % np.uint64(buckets)).astype(np.int64), at[low], count


def scattered(docs: DataFrame, k: int, buckets: int, hot: list[int]) -> DataFrame:
    """(bucket, size, blob): what documents (text: binary, KEY) send."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64))  # at most MOST_HOT

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = _codec(), TaskContext.get().partitionId()
        for number, (unknown, a, b, texts) in enumerate(_chunks(batches, CHUNK)):
            chunk = (task << 32) + number
            words = Words(texts, k)
            gone, sent, repeats = _sent(words, _ranks(unknown, a))
            bucket, word, count = _super_kmers(words, sent, buckets, shared.value)
            order = np.argsort(bucket, kind="stable")
            out = []
            for low, high in _equal(bucket[order]):
                own = order[low:high]
                strings = [words.packed(w, c) for w, c in zip(word[own].tolist(), count[own].tolist(), strict=True)]
                doc = words.text[word[own]]
                which, seat = np.unique(doc, return_inverse=True)
                out.append((int(bucket[own[0]]), _packed(chunk, which, unknown[which], a[which], seat, word[own] - words.first[doc], strings)))
            # The chunk's documents and what is settled here go along to a bucket of the chunk's choice.
            doc = words.text[words.windows[gone]]
            edge, spans = np.searchsorted(doc, np.arange(len(texts) + 1)), []
            again = set(repeats.tolist())
            for d in range(len(texts)):
                mine = _spans(words.windows[gone[edge[d] : edge[d + 1]]] - words.first[d])
                spans.append(np.concatenate([mine, REPEATS]) if d in again else mine)
            out.append((chunk * 31 % buckets, _settled(chunk, unknown, a, b, spans)))
            for low in range(0, len(out), BLOBS):
                to, raw = zip(*out[low : low + BLOBS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], names=["bucket", "size", "blob"])

    return docs.mapInArrow(scatter, "bucket long, size long, blob binary")


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _packed(chunk: int, which: np.ndarray, unknown: np.ndarray, a: np.ndarray, seat: np.ndarray, word: np.ndarray, strings: list[bytes]) -> bytes:
    """A blob of strings: their documents' places in the chunk and ids, and of each its document (in steps), its first word and its text."""
    head = np.array([chunk, len(a), len(strings)], np.int64)
    steps = lambda x: np.diff(x, prepend=0).astype(np.int32).tobytes()
    return b"".join([head.tobytes(), steps(which), unknown.astype(np.uint8).tobytes(), np.diff(a, prepend=0).tobytes(), steps(seat), word.astype(np.int32).tobytes(), b"\n".join(strings)])


def _settled(chunk: int, unknown: np.ndarray, a: np.ndarray, b: np.ndarray, spans: list[np.ndarray]) -> bytes:
    """A blob of all documents of a chunk: their keys, the number of their settled spans, and the spans."""
    head = np.array([chunk, len(a), -1], np.int64)
    counts = np.array([len(s) for s in spans], np.int32)
    return b"".join([head.tobytes(), unknown.astype(np.uint8).tobytes(), np.diff(a, prepend=0).tobytes(), b.tobytes(), counts.tobytes(), np.concatenate(spans).tobytes()])


class _Reader:
    """Arrays from a blob, one after another."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def __call__(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out


def reported(blobs: DataFrame, k: int) -> DataFrame:
    """(KEY, spans): windows that a smaller document holds too, as int32 pairs (first window, count), by document."""

    def count(_: tuple, rows: pa.Table) -> pa.Table:
        codec = _codec()
        places, unknown, a, seats, at, strings, out = [], [], [], [], [], [], []
        held = 0
        for size, blob in zip(rows["size"].to_pylist(), rows["blob"].to_pylist(), strict=True):
            take = _Reader(codec.decompress(blob, size, asbytes=True))
            chunk, docs, n = take(np.int64, 3).tolist()
            if n < 0:
                key = take(np.uint8, docs).astype(bool).tolist(), np.cumsum(take(np.int64, docs)).tolist(), take(np.int64, docs).tolist()
                counts = take(np.int32, docs)
                spans = np.split(take(np.int32, 2 * int(counts.sum())).reshape(-1, 2), np.cumsum(counts)[:-1])
                out += [(chunk, d, *own, s.tobytes() or None) for d, (*own, s) in enumerate(zip(*key, spans, strict=True))]
                continue
            places += [(chunk, d) for d in np.cumsum(take(np.int32, docs)).tolist()]
            unknown.append(take(np.uint8, docs).astype(bool))
            a.append(np.cumsum(take(np.int64, docs)))
            seats.append(np.cumsum(take(np.int32, n)) + held)
            at.append(take(np.int32, n))
            strings += take.raw[take.at :].split(b"\n")
            held += docs
        if strings:
            seat, at = np.concatenate(seats), np.concatenate(at)
            rank = _ranks(np.concatenate(unknown), np.concatenate(a))
            words = Words(strings, k)
            lead, own = words.leaders(rank[seat]), words.text[words.windows]
            gone = np.flatnonzero(rank[seat[own]] > rank[seat[own[lead]]])
            string = own[gone]
            place = words.windows[gone] - words.first[string] + at[string]
            order = np.lexsort((place, seat[string]))
            doc, place = seat[string][order], place[order]
            for low, high in _equal(doc):
                out.append((*places[doc[low]], None, None, None, _spans(place[low:high]).tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["chunk", "doc", "unknown", "a", "b", "spans"])

    told = blobs.groupBy("bucket").applyInArrow(count, f"chunk long, doc long, {KEY}, spans binary")
    # A document's reports meet its key, which its chunk has sent once.
    of_doc = told.groupBy("chunk", "doc").agg(*(F.max(c).alias(c) for c in ("unknown", "a", "b")), F.collect_list("spans").alias("spans")).where(F.size("spans") > 0)
    return of_doc.groupBy("unknown", "a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(text: bytes, spans: list[bytes], k: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them the reported windows cover."""
    words = text.split()
    found = np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2) for s in spans])
    if (found[:, 0] < 0).any():
        found = found[found[:, 0] >= 0]
        own = Words([b" ".join(words)], k)
        places = np.concatenate([np.arange(f, f + n) for f, n in found.tolist()] or [np.zeros(0, np.int64)])
        lead = own.leaders(np.zeros(1, np.int64))
        hit = np.zeros(len(lead), bool)
        hit[lead[places]] = True
        found = _spans(np.flatnonzero(hit[lead]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 0] + found[:, 1] + k - 1, -1)
    return words, np.cumsum(edge)[:-1] > 0


def hot_minimisers(docs: DataFrame, k: int, buckets: int) -> list[int]:
    """Minimisers (as longs) that the sampled documents show to hold much of a bucket."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unknown, a, _, texts in _chunks(batches, CHUNK):
            words = Words(texts, k)
            least, n = np.unique(words.minimisers()[_sent(words, _ranks(unknown, a))[1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n.astype(np.int64))], names=["least", "n"])

    if buckets < 2:
        return []
    counts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(seen, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    with staging(docs.sparkSession):
        counts = staged(counts, "substring-minimisers")
        total = counts.agg(F.sum("n")).first()[0] or 0
        # What is seen once or twice says nothing; no more than MOST_HOT can have the share.
        least = max(2, total / (8 * buckets), total / MOST_HOT)
        return [r["least"] for r in counts.where(F.col("n") > least).select("least").collect()]


def without_repeated(docs: DataFrame, carry: dict[str, Column] | None = None, k: int = 13, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET) -> DataFrame:
    """Per row: ``carry``'s columns, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space."""
    spark = docs.sparkSession
    prepare(spark)
    extra = carry if carry is not None else {doc_id: F.col(f"`{doc_id}`")}
    own, number = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    # The key's hashes are of the text; a null text needs none.
    key = {"unknown": number.isNull(), "a": F.coalesce(number, F.xxhash64(own)), "b": F.xxhash64(F.lit("b"), own)}
    carried = [f"_c{i}" for i in range(len(extra))]
    rows = docs.select(own.cast("binary").alias("text"), *(c.alias(n) for n, c in key.items()), *(c.alias(n) for n, c in zip(carried, extra.values(), strict=True)))
    texts = rows.select("text", *key)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    buckets = int(max(2 * parallel, 3 * total // bucket_bytes))
    reports = reported(scattered(texts, k, buckets, hot_minimisers(texts, k, buckets)), k)
    met = rows.join(reports, [*key], "left").select(*carried, "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if not s:
                    words = (t or b"").split()
                    made.append((len(words), 0, b" ".join(words).decode()))
                    continue
                words, gone = covered(t, s, k)
                made.append((len(words), int(gone.sum()), b" ".join(compress(words, (~gone).tolist())).decode()))
            n, removed, kept = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*carried, "n_words", "n_removed", "kept"])

    kinds = "".join(f"{c} {met.schema[c].dataType.simpleString()}, " for c in carried)
    told = met.mapInArrow(remove, f"{kinds}n_words long, n_removed long, kept string")
    return told.select(*(F.col(c).alias(n) for c, n in zip(carried, extra, strict=True)), "n_words", "n_removed", "kept")
