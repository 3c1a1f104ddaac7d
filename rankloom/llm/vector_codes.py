"""Compression of vectors to short codes: a codebook for each part, nearest entries found in kd-trees.

A vector's components become integers, floor(scale x x), and are cut into ``parts`` consecutive runs.
Each part position has a codebook, at first the parts of the smallest ids. A round broadcasts
a kd-tree for each codebook (at most ``entries`` x width integers); tasks search it for every part by branch
and bound and add the parts of each entry; Spark adds the tasks' integer sums; each entry becomes
the floor of its mean. A node is visited unless its box is farther than the best entry so far, so
boxes at an equal distance are visited too, and of equally near entries the smallest index wins.
All arithmetic is on integers: results don't depend on order, tasks or retries.

The table is read once; its integers are staged and read by every round. Only sums are shuffled (a
task gives at most parts x entries x width rows).

Edge cases: vectors that are null or hold null or non-finite components are dropped. Vectors
of another length than the most common one (ties: the shorter), and those with an integer so large
that errors might not fit 64 bits, are kept with null code and error and teach nothing. Equal
ids are ordered by vector, null ids last; with fewer rows than ``entries`` a codebook has as many entries as
rows; a length that ``parts`` doesn't divide is cut as evenly as it goes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import prepare, staged

#: Entries of a leaf: scanned at once.
LEAF = 8
#: Parts searched at a time.
BATCH_ROWS = 8192


class Tree:
    """A kd-tree over the rows of ``entries``, with the bounding box of every node."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(entries)) if index is None else index
        self.points = own = entries[self.index]
        self.low, self.high = own.min(0), own.max(0)
        self.children: tuple[Tree, Tree] | None = None
        if len(own) > LEAF and (self.high > self.low).any():
            order = np.argsort(own[:, int(np.argmax(self.high - self.low))], kind="stable")
            middle = len(order) // 2
            self.children = (Tree(entries, self.index[order[:middle]]), Tree(entries, self.index[order[middle:]]))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row of x to the box."""
        apart = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each row of x; of ties the smallest index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        at = np.full(len(x), np.iinfo(np.int64).max)
        self._search(x, np.arange(len(x)), self.bound(x), best, at)
        return at, best

    def _search(self, x: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        open_ = bound <= best[rows]
        rows = rows[open_]
        if not len(rows):
            return
        q = x[rows]
        if self.children is None:
            for i, p in zip(self.index.tolist(), self.points, strict=True):
                apart = q - p
                d = np.einsum("ij,ij->i", apart, apart)
                hit = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
                best[rows[hit]], at[rows[hit]] = d[hit], i
            return
        left, right = self.children
        to_left, to_right = left.bound(q), right.bound(q)
        for mine, first, second, near, far in ((to_left <= to_right, left, right, to_left, to_right), (to_left > to_right, right, left, to_right, to_left)):
            first._search(x, rows[mine], near[mine], best, at)
            second._search(x, rows[mine], far[mine], best, at)


def cuts(width: int, parts: int) -> list[int]:
    return [width * p // parts for p in range(parts + 1)]


def _integers(column: pa.Array) -> np.ndarray:
    """A list column of one width as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def quantized(vectors: DataFrame, vector_col: str, scale: int, carry: dict[str, Column]) -> tuple[DataFrame, int | None]:
    """``carry``'s columns and ``v``, floor(scale x x) of the kept vectors (null where it can't be coded), staged;
    and the vectors' width, None for an empty table."""
    as_double = vectors.select(*(c.alias(n) for n, c in carry.items()), F.col(f"`{vector_col}`").cast("array<double>").alias("_x"))
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = as_double.where(F.col("_x").isNotNull() & F.coalesce(finite, F.lit(False)))
    most = kept.groupBy(F.size("_x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = most["n"] if most else None
    limit = min(isqrt((1 << 58) // (width or 1)), (1 << 31) - 1)  # an error is at most 4 x width x limit squared
    near = (F.size("_x") == F.lit(width)) & F.forall("_x", lambda x: F.abs(x * scale) < limit)
    floors = F.transform("_x", lambda x: F.floor(x * scale).cast("int"))
    return staged(kept.withColumn("v", F.when(near, floors)).drop("_x"), "vector-codes-integers"), width


def _trees(books: list[np.ndarray]) -> list[Tree]:
    return [Tree(b) for b in books]


def fitted(rows: DataFrame, id_col: str, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebook of each part position, after all rounds: entries x width of the part, integers."""
    spark = rows.sparkSession
    known = rows.where("v IS NOT NULL")
    first = known.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), "v").select("v").limit(entries).collect()  # a codebook's entries
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    edge = cuts(width, parts)
    books = [start[:, a:b].copy() for a, b in zip(edge, edge[1:], strict=False)]
    for _ in range(rounds if first else 0):
        shared = spark.sparkContext.broadcast(_trees(books))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trees = shared.value
            total = [np.zeros((len(first), b - a + 1), np.int64) for a, b in zip(edge, edge[1:], strict=False)]
            for batch in _slices(batches):
                x = _integers(batch.column(0))
                for p, tree in enumerate(trees):
                    own = x[:, edge[p] : edge[p + 1]]
                    at = tree.nearest(own)[0]
                    np.add.at(total[p], (at, slice(1, None)), own)
                    total[p][:, 0] += np.bincount(at, minlength=len(first))
            for p, t in enumerate(total):
                used = np.flatnonzero(t[:, 0])
                entry, place = np.repeat(used, t.shape[1]), np.tile(np.arange(t.shape[1]), len(used))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(t[used].ravel())], names=["part", "entry", "place", "total"])

        told = known.select("v").mapInArrow(sums, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in told.collect()}  # at most parts x entries x width
        for (p, e, place), total in found.items():
            if place:
                books[p][e, place - 1] = total // found[p, e, 0]
        shared.unpersist()
    return books


def encoded(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``rows`` (v: integers) with ``code`` (the entry of each part) and ``error``, the sum of squared distances; null where v is."""
    shared = rows.sparkSession.sparkContext.broadcast(_trees(books))
    edge = cuts(width, len(books))
    others = [c for c in rows.columns if c != "v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            v = batch.column("v")
            has = ~v.is_null().to_numpy(zero_copy_only=False)
            code, error = np.zeros((len(has), len(books)), np.int32), np.zeros(len(has), np.int64)
            if has.any():
                x = _integers(v.drop_null())
                for p, tree in enumerate(shared.value):
                    at, d = tree.nearest(x[:, edge[p] : edge[p + 1]])
                    code[has, p] = at
                    error[has] += d
            offsets = pa.array(np.arange(len(has) + 1, dtype=np.int32) * len(books))
            codes = pa.ListArray.from_arrays(offsets, pa.array(code.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), codes, pa.array(error, mask=~has)], names=[*others, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v")
    return rows.mapInArrow(assign, f"{kinds}, code array<int>, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: dict[str, Column] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """``id_col``, the columns of ``carry``, ``code`` (array of entry indexes) and ``error`` of each kept vector; and the codebooks."""
    prepare(vectors.sparkSession)
    own = {"_id": F.col(f"`{id_col}`"), **{f"_c{i}": c for i, c in enumerate((carry or {}).values())}}
    rows, width = quantized(vectors, vector_col, scale, own)
    books = fitted(rows, "_id", width or 0, parts, entries, rounds)
    if not len(books[0]):
        coded = rows.drop("v").withColumns({"code": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long")})
    else:
        coded = encoded(rows, books, width or 0)
    names = {"_id": id_col, **{f"_c{i}": n for i, n in enumerate(carry or {})}}
    return coded.select(*(F.col(c).alias(n) for c, n in names.items()), "code", "error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex sha256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_text(code: Column) -> Column:
    """Two lowercase hex digits a part."""
    return F.array_join(F.transform(code, lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
