"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred and rotated so that their signs lose least (iterative
quantisation: principal axes, then alternating rotations), by as many rotations from
different starts as the ``bits`` need, fitted on a bounded sample; every vector is coded.
Index: a code is cut into substrings of at least log2(rows) bits (8, 16 or 32), and a row is found under each
(substring, value). Search: a query probes all values that differ from its own in at most a bits, and an equi-join on
(substring, value) retrieves rows: with m substrings every code within m (a + 1) - 1 bits (pigeonhole). A
pair is taken under the first substring that retrieves it, hence once.

Every query has its own radius. First it probes a = 1; the nearest codes that this retrieves are ranked by exact distance, and the
distance of its 0.9 k-th neighbour so far tells, by what a sample shows of distances and code distances, within which radius
``coverage`` of the vectors that near have their codes. Then it probes as far as that radius asks, and all codes within it are ranked
by exact Euclidean distance. A query for which the probes would retrieve more than half of all rows (or of which too little was
retrieved to tell) reads one substring's index whole, every value of it: that is all codes, once, in blocks; it is marked ``scanned``. Its radius
is told by the nearest of these, and exact distances are worked out within it only.

Shuffled are codes by (substring, value), probes, and the vectors of pairs within the radius. ``met`` is how many codes a
query has met, ``radius`` how far it looked. In tight clusters that is a small share of the rows; where vectors are isotropic
every query needs a radius of a third of the bits, no index prunes, and each row is met about once.

One rule for repeats: every distinct (id, vector) is a candidate once, whatever its number of
rows; an id asked with several vectors asks with the smallest. Equal vectors are one entry
of the index with their k + 1 smallest ids; that is exact, as further ones can't be among
the k nearest with ties to smaller ids.

Edge cases: vectors that are null, of zero norm, empty, of another length than the
most common one, or hold null or non-finite components take no part, as queries or as
candidates, nor do null ids; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import prepare, staged

#: Bits of one column of a code.
LONG_BITS = 64
#: Bits that may differ in a substring in the first round, and at least in the second; codes whose vectors tell a query's radius, and the share of
#: the rows (and the probes) up to which probing goes.
FIRST, SECOND, TELLING, MOST_MET, MOST_PROBES = 1, 2, 256, 0.5, 100_000


class BinaryCoder:
    """A centre and rotations; codes are the signs of the rotated vector, as bytes."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 25, seed: int = 3):
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        turns, left = [], bits
        while left > 0:
            v = x @ axes[:, :left]
            r = np.linalg.qr(np.random.default_rng(seed + len(turns)).normal(size=(v.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(v.T @ np.sign(v @ r))
                r = u @ w
            turns.append(axes[:, :left] @ r)
            left -= v.shape[1]
        self.turn = np.concatenate(turns, 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


_ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ones[a ^ b].sum(-1, dtype=np.int32)


def substring_bits(rows: int) -> int:
    """At least log2(rows), so that few rows share a value by chance; a width that divides a long."""
    return 8 if rows <= 1 << 6 else 16 if rows <= 1 << 16 else 32


@lru_cache(maxsize=64)
def masks(width: int, allowed: int) -> np.ndarray:
    """All patterns of at most ``allowed`` bits of a substring."""
    return np.array([sum(1 << b for b in s) for n in range(min(allowed, width) + 1) for s in combinations(range(width), n)], np.int64)


def values(codes: np.ndarray, width: int) -> np.ndarray:
    """The substrings of codes (bytes), as integers."""
    return codes.reshape(len(codes), -1, width // 8).astype(np.int64) @ (np.int64(1) << np.arange(0, width, 8, dtype=np.int64))


def probed_keys(codes: np.ndarray, width: int, allowed: int) -> np.ndarray:
    """The names of all (substring, value) that each code probes, a row a code."""
    own = values(codes, width)
    named = (np.arange(own.shape[1], dtype=np.int64) << width)[None, :, None] + (own[:, :, None] ^ masks(width, allowed)[None, None])
    return named.reshape(len(codes), -1)


def allowance(radius: int, substrings: int) -> int:
    """Bits that may differ in each substring so that every code within the radius is retrieved."""
    return max(0, -(-(radius + 1) // substrings) - 1)


def learned_reach(coder: BinaryCoder, sample: np.ndarray, coverage: float, queries: int = 256, near: int = 64) -> list[float]:
    """For each radius the largest distance of which ``coverage`` of the pairs have their codes within it; never falling.

    The pairs are queries of the sample with their nearest ones, with random ones, and with places on the way to the nearest.
    """
    bits = coder.turn.shape[1]
    if len(sample) < 2:
        return [float("inf")] * (bits + 1)
    rng = np.random.default_rng(9)
    q = sample[:: max(1, len(sample) // queries)][:queries]
    far, apart = [], []
    for x, c in zip(q, coder.codes(q), strict=True):
        d = ((sample - x) ** 2).sum(1)
        d[d == 0] = np.inf
        close = sample[np.argsort(d, kind="stable")[:near]]
        others = np.concatenate([close, sample[rng.integers(0, len(sample), near)], *(x + t * (close[::4] - x) for t in (0.05, 0.15, 0.3, 0.5, 0.7, 0.85))])
        far.append(np.sqrt(((others - x) ** 2).sum(1)))
        apart.append(hamming(coder.codes(others), c))
    far, apart = np.concatenate(far), np.concatenate(apart)
    order = np.argsort(far, kind="stable")
    far, apart = far[order], apart[order]
    window = max(32, len(far) // 200)
    edges = range(0, len(far), window)
    needed = np.maximum.accumulate([np.quantile(apart[at : at + window], coverage) for at in edges])
    last = np.array([far[min(at + window, len(far)) - 1] for at in edges])
    # A window's radius holds for all its distances; no radius below the nearest window's holds for any.
    return [float(last[needed <= r].max()) if (needed <= r).any() else 0.0 for r in range(bits)] + [float("inf")]


def _coded(rows: DataFrame, coder: BinaryCoder) -> DataFrame:
    """``n`` of ``rows`` (n, v) with its code as longs ``c0``, ``c1``, ... and as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)  # dimensions x bits numbers
    longs = -(-coder.turn.shape[1] // LONG_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            codes = shared.value.codes(x)
            wide = np.zeros((len(x), longs * LONG_BITS // 8), np.uint8)
            wide[:, : codes.shape[1]] = codes
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(wide.view("<i8").T)), pa.array([c.tobytes() for c in wide], pa.binary())], names=["n", *(f"c{i}" for i in range(longs)), "code"])

    kind = rows.schema["n"].dataType.simpleString()
    return rows.select("n", "v").mapInArrow(task, f"n {kind}, {', '.join(f'c{i} bigint' for i in range(longs))}, code binary")


def _keyed(coded: DataFrame, width: int, allowed: str | None) -> DataFrame:
    """``coded`` with ``key``, a row for each (substring, value) of its own or, with ``allowed`` (a column), that it probes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([np.frombuffer(c, np.uint8) for c in batch.column("code").to_pylist()], np.uint8)
            reach = batch.column(allowed).to_pylist() if allowed else [0] * len(codes)
            keys = [probed_keys(c[None], width, a)[0] for c, a in zip(codes, reach, strict=True)]
            yield batch.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields)
    slim = coded.mapInArrow(task, f"{kinds}, keys array<bigint>")
    return slim.select(*(c for c in coded.columns if c != "code"), F.explode("keys").alias("key"))


def _met(index: DataFrame, asked: DataFrame, width: int, longs: int) -> DataFrame:
    """(q, e, apart) of all codes that the probes of ``asked`` (n, c0, ..., allowed, key) retrieve, each pair once."""
    probe = asked.select(F.col("n").alias("q"), "allowed", F.col("key").alias("probe"), *(F.col(f"c{i}").alias(f"d{i}") for i in range(longs)))
    differ = [F.col(f"c{i}").bitwiseXOR(F.col(f"d{i}")) for i in range(longs)]
    first = F.lit(-1)
    per_long = LONG_BITS // width
    ones = (1 << width) - 1
    for j in reversed(range(longs * per_long)):
        bits = F.bit_count(F.shiftrightunsigned(differ[j // per_long], width * (j % per_long)).bitwiseAND(F.lit(ones).cast("long")))
        first = F.when(bits <= F.col("allowed"), F.lit(j)).otherwise(first)
    met = index.withColumnRenamed("n", "e").join(probe, (F.col("key") == F.col("probe")) & (F.shiftright("key", width) == first))
    return met.select("q", "e", reduce(lambda a, b: a + b, [F.bit_count(x) for x in differ]).alias("apart"))


def _read_whole(codes: DataFrame, asked: DataFrame, blocks: int, query_blocks: int, nearest: int | None, id_kind: str) -> DataFrame:
    """(q, e, apart) of every query with all codes: the ``nearest`` of each block, or else those within the query's ``radius``."""
    turn = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = codes.select(F.pmod(F.xxhash64("n"), F.lit(blocks)).alias("b"), turn(query_blocks).alias("s"), "n", "code")
    right = asked.select(turn(blocks).alias("b"), F.pmod(F.xxhash64("n"), F.lit(query_blocks)).alias("s"), F.col("n").alias("q"), "code", "radius")

    def search(_: tuple, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(e) and len(q):
            words = lambda c: np.frombuffer(b"".join(c), np.uint64).reshape(len(c), -1)
            e = e.sort_values("n")
            own, ids = words(e["code"].to_list()), e["n"].to_numpy()
            for name, code, radius in zip(q["q"], words(q["code"].to_list()), q["radius"], strict=True):
                apart = np.bitwise_count(own ^ code).sum(1, dtype=np.int32)
                if nearest is None:
                    at = np.flatnonzero(apart <= radius)
                else:
                    at = np.argpartition(apart, nearest)[:nearest] if len(apart) > nearest else np.arange(len(apart))
                out.append(pd.DataFrame({"q": name, "e": ids[at], "apart": apart[at]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "e": [], "apart": []})

    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(search, f"q {id_kind}, e bigint, apart int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, sample_rows: int = 10_000, coverage: float = 0.97, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """The k nearest found of each row for which ``is_query`` (over ``id_col``) holds: ``query_id``, ``rank``, ``vec_id``,
    ``score`` (Euclidean distance), ``scanned``, ``radius`` and ``met``. ``bits`` is a multiple of 64."""
    spark = vectors.sparkSession
    prepare(spark)
    id_kind = vectors.schema[id_col].dataType.simpleString()
    as_double = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = as_double.where(sound).withColumn("q", F.coalesce("q", F.lit(False)))
    dimensions = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dimensions is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double, scanned boolean, radius int, met bigint")
    usable = usable.where(F.size("v") == dimensions["n"])
    # One entry for each vector. Repeats are combined before they are dealt out, and window group limits keep
    # k + 1 ids of a vector in every task.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = usable.select("id", "v").distinct().withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = staged(entries.withColumn("n", F.monotonically_increasing_id()), "nearest-entries")
    asked = staged(usable.where("q").groupBy(F.col("id").alias("n")).agg(F.min("v").alias("v")), "nearest-queries")
    total = entries.count()
    # About sample_rows vectors with the smallest hashes: a threshold, so no task gathers the others'.
    cut = int(min(1.0, sample_rows / total) * (1 << 30))
    drawn = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < cut).select("v").limit(2 * sample_rows).collect()
    drawn = drawn or entries.select("v").limit(sample_rows).collect()
    sample = np.array(sorted(r["v"] for r in drawn))
    coder = BinaryCoder(sample, bits)
    width, longs = substring_bits(total), bits // LONG_BITS
    substrings = bits // width
    reach = F.array(*(F.lit(d) for d in learned_reach(coder, sample, coverage)))
    codes = staged(_coded(entries, coder), "nearest-codes")
    asked_codes = staged(_coded(asked, coder), "nearest-asked")
    index = _keyed(codes, width, None)
    vector_of = entries.select(F.col("n").alias("_e"), "ids", F.col("v").alias("x"))
    asked_of = asked.select(F.col("n").alias("_q"), "v")
    square = F.aggregate(F.zip_with("x", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    def ranked(pairs: DataFrame) -> DataFrame:
        """(q, vec_id, score) of pairs (q, e), by exact distances; the k best of each query."""
        met = pairs.join(vector_of, F.col("e") == F.col("_e")).join(asked_of, F.col("q") == F.col("_q"))
        found = met.select("q", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> q")
        return best(found)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def told(found: DataFrame, of: DataFrame) -> DataFrame:
        """The radius of each query: what the distance of its 0.9 k-th neighbour so far needs; null where there are too few."""
        at = found.where(F.col("rank") == max(1, min(ceil(0.9 * k), total - 1))).select(F.col("q").alias("_q"), F.col("score").alias("_d"))
        needs = F.when(F.col("_d").isNotNull(), F.size(F.filter(reach, lambda d: d < F.col("_d"))))
        return of.join(at, F.col("n") == F.col("_q"), "left").select("n", *(f"c{i}" for i in range(longs)), "code", needs.alias("radius"))

    def telling(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("apart", "e")
        return pairs.withColumn("_near", F.row_number().over(order)).where(F.col("_near") <= TELLING).select("q", "e")

    # First round: few probes, whose nearest codes tell each query's radius.
    begun = staged(_met(index, _keyed(asked_codes.withColumn("allowed", F.lit(FIRST)), width, "allowed"), width, longs), "nearest-begun")
    some = staged(ranked(telling(begun)), "nearest-some")
    allowed = F.greatest(F.lit(0), F.ceil((F.col("radius") + 1) / substrings).cast("int") - 1)
    first = told(some, asked_codes).withColumn("allowed", allowed)
    # How far probing pays.
    far = max([a for a in range(width + 1) if (n := substrings * sum(comb(width, i) for i in range(a + 1))) <= MOST_PROBES and n * total / 2.0**width <= MOST_MET * total], default=-1)
    first = staged(first, "nearest-radius")
    probing = first.where(F.col("radius").isNotNull() & (F.col("allowed") <= far)).withColumn("allowed", F.greatest("allowed", F.lit(min(far, SECOND))))
    probed = _met(index, _keyed(probing, width, "allowed"), width, longs)
    pairs = staged(probed.join(probing.select(F.col("n").alias("_n"), "radius"), F.col("q") == F.col("_n")).select("q", "e", "apart", "radius"), "nearest-pairs")
    met = begun.groupBy("q").agg(F.count(F.lit(1)).alias("n")).unionByName(pairs.groupBy("q").agg(F.count(F.lit(1)).alias("n"))).groupBy(F.col("q").alias("_m")).agg(F.sum("n").alias("met"))
    # What was retrieved beyond the radius may still fill up the k.
    order = Window.partitionBy("q").orderBy("apart", "e")
    close = pairs.withColumn("_near", F.row_number().over(order)).where((F.col("apart") <= F.col("radius")) | (F.col("_near") <= k + 1))
    found = staged(best(some.drop("rank").unionByName(ranked(close.select("q", "e")).drop("rank")).distinct()), "nearest-found")
    # A query that is short of neighbours (or of a radius) reads all codes.
    ids = entries.select(F.explode("ids")).distinct().limit(k + 1).count()
    full = found.where(F.col("rank") == min(k, ids - 1)).select("q").join(probing.select(F.col("n").alias("q")), "q", "left_semi")
    whole = staged(first.join(full, F.col("n") == F.col("q"), "left_anti"), "nearest-whole")
    few = whole.count()
    radius = probing.join(full, F.col("n") == F.col("q"), "left_semi").select("n", "radius", F.lit(False).alias("scanned"))
    if few:
        blocks, query_blocks = -(-total // block_rows), -(-few // query_rows)
        # Blocks are dealt by hash: each gives its share of the TELLING nearest, twice over. They only tell a radius.
        share = max(k + 1, -(-2 * TELLING // blocks))
        close = staged(ranked(telling(_read_whole(codes, whole, blocks, query_blocks, share, id_kind))), "nearest-close")
        again = staged(told(close, whole).withColumn("radius", F.coalesce("radius", F.lit(bits))), "nearest-again")
        rest = ranked(_read_whole(codes, again, blocks, query_blocks, None, id_kind).select("q", "e"))
        found = best(found.drop("rank").unionByName(close.drop("rank")).unionByName(rest.drop("rank")).distinct())
        radius = radius.unionByName(again.select("n", "radius", F.lit(True).alias("scanned")))
    out = found.join(radius, F.col("q") == F.col("n")).join(met, F.col("q") == F.col("_m"), "left")
    seen = F.coalesce("met", F.lit(0)) + F.when(F.col("scanned"), total).otherwise(0)
    return out.select(F.col("q").alias("query_id"), "rank", "vec_id", "score", "scanned", F.col("radius").cast("int").alias("radius"), seen.cast("long").alias("met"))
