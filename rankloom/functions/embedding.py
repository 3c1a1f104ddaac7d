"""Deterministic text vectors by signed feature hashing, as an Arrow UDF.

Words, their 3- to 5-letter parts and pairs of neighbouring words are weighted by the
line's place in the text, counted, log-scaled and spread over six signed positions.
The features of a batch of texts are hashed together, byte by byte, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384

# Stop words, hash constants, weights.
STOP_WORDS = frozenset(
    "a an the and or but if then else when at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further once here there all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven "
    "isn ma mightn mustn needn shan shouldn wasn weren won wouldn is are was were be been being have has had".split()
)
FNV_PRIME, FNV_SEEDS = 16777619, (0x811C9DC5, 0x9E3779B9)
HEADS, HEAD_STEP = 6, 0x654321
PART_WEIGHT, PAIR_WEIGHT = 0.35, 1.5
TOP_SHARE, TOP_WEIGHT, END_SHARE, END_WEIGHT = 0.25, 1.4, 0.85, 1.1

#: Weight of a word, a part and a pair in a line, by the line's weight.
LINE_WEIGHTS = {w: tuple(float(np.float32(x) * np.float32(w)) for x in (1.0, PART_WEIGHT, PAIR_WEIGHT)) for w in (1.0, TOP_WEIGHT, END_WEIGHT)}
#: Texts whose features are hashed together, and features a worker holds before it forgets them.
TEXTS_AT_ONCE, HELD_FEATURES = 512, 1_000_000

#: The weights by kind (word, part, pair) and line (plain, top, end); the share of each head.
_WEIGHTS = np.array([LINE_WEIGHTS[w] for w in (1.0, TOP_WEIGHT, END_WEIGHT)], np.float32).T
SHARES = np.float32(1) / (np.float32(1) + np.arange(HEADS, dtype=np.float32) * np.float32(0.25))
_LOW, _PAIR = (1 << 32) - 1, np.int64(-(1 << 63))

_words = re.compile(r"[\w+#.]+").findall  # of a text without ``_``


def fnv1a(keys: list[bytes], seed: int) -> np.ndarray:
    """32-bit FNV-1a of many keys at once."""
    sizes = np.array([len(k) for k in keys], np.int64)
    return continued(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(sizes) - sizes, sizes, np.full(len(keys), seed, np.uint32))


def continued(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes taken on over slices of bytes, byte by byte over the slices that are long enough."""
    order = np.argsort(-sizes, kind="stable")
    sizes, starts, h = sizes[order], starts[order], hashes[order]
    for at in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -at))  # slices longer than ``at`` come first
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * np.uint32(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


class _Numbers(dict):
    """Numbers of names as they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Features:
    """The features of texts. Words and their parts are numbered as a worker meets them; pairs are those of a batch.

    A pair's name is that of its first word, ``_`` and its second one, and ``_`` is in no other name: so its hash goes on from the
    first one's, and its place in byte order follows from those of the first word with ``_`` and of the second word.
    """

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.keys: list[bytes] = []  # names of features, and of words with ``_``
        self.order: list[int] = []  # their numbers in byte order
        self.words = _Numbers()
        self.known = 0
        self.flat = self.start = self.size = self.after = np.zeros(0, np.int64)
        self.rank = np.zeros(0, np.int64)
        self.hashes = np.zeros((2, 0), np.uint32)
        self.letters, self.letters_at = np.zeros(0, np.uint8), np.zeros((2, 0), np.int64)

    @staticmethod
    def of_word(w: str) -> list[str]:
        """The word and its parts; nothing for a stop word or a single byte."""
        size = len(w.encode())
        if size < 2 or w in STOP_WORDS:
            return []
        return [w] + (["#" + w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] if size >= 4 else [])

    def learn(self) -> None:
        """What the words met since the last time consist of."""
        new = list(islice(reversed(self.words), len(self.words) - self.known))[::-1]
        if not new:
            return
        held = len(self.keys)
        parts = [self.of_word(w) for w in new]
        size = np.array([len(x) for x in parts], np.int64)
        number = self.number
        flat, after = [number[x] for own in parts for x in own], [number[w + "_"] for w in new]
        self.keys += [x.encode() for x in list(islice(reversed(number), len(number) - held))[::-1]]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int64)])
        self.after = np.concatenate([self.after, np.array(after, np.int64)])
        keys = [w.encode() for w in new]
        lengths = np.array([len(k) for k in keys], np.int64)
        self.letters_at = np.concatenate([self.letters_at, [len(self.letters) + np.cumsum(lengths) - lengths, lengths]], axis=1)
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(keys), np.uint8)])
        self.hashes = np.concatenate([self.hashes, [fnv1a(self.keys[held:], s) for s in FNV_SEEDS]], axis=1)
        self.order += range(held, len(self.keys))
        self.order.sort(key=self.keys.__getitem__)
        self.rank = np.empty(len(self.keys), np.int64)
        self.rank[self.order] = np.arange(len(self.keys))
        self.known = len(self.words)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, lines and lines' weights (0 plain, 1 top, 2 end) of all words."""
        lines = [x for x in (text or "").lower().split("\n") if x and not x.isspace()]
        found = [_words(line.replace("_", " ")) for line in lines]
        share = np.arange(len(lines), dtype=np.float32) / np.float32(max(1, len(lines)))
        kind = np.where(share < np.float32(TOP_SHARE), 1, np.where(share > np.float32(END_SHARE), 2, 0))
        counts = [len(ws) for ws in found]
        ids = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, sum(counts))
        return ids, np.repeat(np.arange(len(lines)), counts), np.repeat(kind, counts)

    def uses(self, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of kept words in reading order with their weights, and pairs (two numbers in one) with theirs."""
        kept = self.size[tokens[0]] > 0
        ids, line, kind = (x[kept] for x in tokens)
        size = self.size[ids]
        first = np.cumsum(size) - size
        found = self.flat[np.repeat(self.start[ids] - first, size) + np.arange(size.sum())]
        weights = np.repeat(_WEIGHTS[1][kind], size)
        weights[first] = _WEIGHTS[0][kind]
        near = line[1:] == line[:-1]
        return found, weights, ids[:-1][near] << 32 | ids[1:][near], _WEIGHTS[2][kind[1:][near]]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features by their place in ``keys`` with the weight of each use: first words and parts, then pairs."""
        tokens = self.tokens(text)
        self.learn()
        found, weights, pairs, of_pairs = self.uses(tokens)
        names = [n.decode() for n in self.names(pairs + _PAIR)]
        number, held = self.number, len(self.keys)
        ids = np.array([number[n] for n in names], np.int64)
        self.keys += [n.encode() for n in list(islice(reversed(number), len(number) - held))[::-1]]
        self.hashes = np.concatenate([self.hashes, [fnv1a(self.keys[held:], s) for s in FNV_SEEDS]], axis=1)
        self.order += range(held, len(self.keys))
        return np.concatenate([found, ids]), np.concatenate([weights, of_pairs])

    def batch(self, texts: Iterable[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """The uses of each text as (features, weights), their hashes, and what they are: a number, or a pair less 2^63.

        Features are numbered in their byte order among those of the batch.
        """
        if len(self.keys) > HELD_FEATURES:
            self.clear()
        read = [self.tokens(t) for t in texts]
        self.learn()
        used = [self.uses(t) for t in read]
        flags = np.zeros(len(self.keys), bool)
        for found, *_ in used:
            flags[found] = True
        met = np.flatnonzero(flags)
        pairs, inverse = np.unique(np.concatenate([u[2] for u in used] or [met[:0]]), return_inverse=True)
        a, b = pairs >> 32, pairs & _LOW
        place = np.concatenate([self.rank[met] << 32, self.rank[self.after[a]] << 32 | 1 + self.rank[self.flat[self.start[b]]]])
        order = np.argsort(place)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of_feature = np.zeros(len(self.keys), np.int64)
        of_feature[met], of_pair = rank[: len(met)], rank[len(met) :][inverse]
        hashes = np.stack([np.concatenate([h[met], continued(self.letters, *self.letters_at[:, b], h[self.after[a]])])[order] for h in self.hashes])
        out, at = [], 0
        for found, weights, own, of_own in used:
            out.append((np.concatenate([of_feature[found], of_pair[at : at + len(own)]]), np.concatenate([weights, of_own])))
            at += len(own)
        return out, hashes, np.concatenate([met, pairs + _PAIR])[order]

    def names(self, what: np.ndarray) -> list[bytes]:
        """The names of a batch's features."""
        of_pair = lambda p: self.keys[self.after[p >> 32]] + self.keys[self.flat[self.start[p & _LOW]]]
        return [self.keys[n] if n >= 0 else of_pair(n - int(_PAIR)) for n in what.tolist()]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of features in a vector and their signs, a column for each head."""
        head = np.arange(HEADS, dtype=np.uint32)[None]
        seed = (hashes[0][:, None] + head * np.uint32(HEAD_STEP)) ^ (hashes[1][:, None] * (head + np.uint32(1)))
        return (seed % np.uint32(self.dim)).astype(np.int64), np.where((seed >> np.uint32(16)) & np.uint32(1), np.float32(-1), np.float32(1))

    def vectors(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Unit vectors of texts; zeros for a text without features."""
        used, hashes, _ = self.batch(texts)
        place, sign = self.places(hashes)
        out = []
        for at, tf in summed(used, hashes.shape[1], np.float32):
            vector = np.zeros(self.dim, np.float32)
            if len(at):
                scaled = np.float32(1) + np.log(tf.astype(float)).astype(np.float32)
                np.add.at(vector, place[at].ravel(), (sign[at] * scaled[:, None] * SHARES).ravel())  # float sums depend on order: bytes, ascending
                vector /= 1 + np.abs(vector)
                length = np.sqrt((vector.astype(float) ** 2).sum())
                vector = vector if length <= 1e-12 else (vector / length).astype(np.float32)
            out.append(vector)
        return out


def summed(used: list[tuple[np.ndarray, np.ndarray]], features: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its features, ascending, and the sums of their weights in reading order."""
    total, met = np.zeros(features, kind), np.zeros(features, bool)
    for found, weights in used:
        np.add.at(total, found, weights.astype(kind, copy=False))
        met[found] = True
        at = np.flatnonzero(met)
        yield at, total[at]
        total[at], met[at] = 0, False


_features: dict[int, Features] = {}


def embed_many(texts: Sequence[str | None], dim: int = DIM) -> list[np.ndarray]:
    held = _features.setdefault(dim, Features(dim))
    return [v for at in range(0, len(texts), TEXTS_AT_ONCE) for v in held.vectors(texts[at : at + TEXTS_AT_ONCE])]


def embed(text: str | None, dim: int = DIM) -> np.ndarray:
    """The unit vector of a text; zeros if it has no feature."""
    return embed_many([text], dim)[0]


def embedding(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_many([t if isinstance(t, str) else None for t in texts], dim))

    return vectors(text)
