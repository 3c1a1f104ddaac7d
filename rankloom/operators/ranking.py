"""Ranking and top-k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.vectors import cosine_similarity


#: Scores that a task holds at a time, in a few arrays of 2 MB each.
SCORES_AT_ONCE = 1 << 18


def ranked(df: DataFrame, group: str, score: str, tie: str, name: str = "rank") -> DataFrame:
    """1..N within each group by falling score (null scores last), ties by ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(order).cast("long"))


def ranked_in_ranges(df: DataFrame, group: str, score: str, tie: str, name: str = "rank", hot_rows: int = 1_000_000, ranges: int = 256) -> DataFrame:
    """``ranked`` where a group may hold a large part of all rows.

    A group of more than ``hot_rows`` rows is cut at approximate quantiles of its scores into at
    most ``ranges`` + 1 ranges; each is ranked by itself and shifted by the rows of the ranges
    above it. Rows of one score stay in one range.
    """
    value = F.nanvl(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("inf")))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(value, shares, 10 * ranges).alias("_cuts")).where(F.col("_rows") > hot_rows)
    higher = F.coalesce(F.size(F.filter("_cuts", lambda c: c > value)), F.lit(0))
    placed = df.join(cuts, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(higher)).drop("_group", "_rows", "_cuts")
    sizes = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_group", "_at", above.alias("_above"))
    order = Window.partitionBy(group, "_range").orderBy(F.desc_nulls_last(score), F.asc(tie))
    within = placed.withColumn("_rank", F.row_number().over(order).cast("long"))
    joined = within.join(shift, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, F.col("_rank") + F.coalesce("_above", F.lit(0))).drop("_rank", "_range", "_group", "_at", "_above")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def similar(vectors: DataFrame, query: Column, k: int = 10, key: str = "resume_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows to one vector (an array expression): exact, one pass, k rows a task."""
    scored = vectors.select(key, cosine_similarity(F.col(vector), query).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(k)


def similar_for_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "resume_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_embedding", most_queries: int | None = None, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """``similar`` for each of any number of queries; more than ``most_queries``, if stated, are refused.

    Rows and queries are hashed into blocks; every block of about ``block_rows`` rows meets
    every block of about ``query_rows`` queries in a task, which scores them by matrix products of
    ``SCORES_AT_ONCE`` pairs and gives k rows a query. Nothing goes through the driver.
    """
    if most_queries is not None and queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries; split the query set")
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(parallel, -(-vectors.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // query_rows))
    # Floats travel as they are: a task makes doubles of what it scores.
    sent = lambda df, name: F.col(name) if df.schema[name].dataType.simpleString() == "array<float>" else F.col(name).cast("array<double>")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = vectors.select(F.pmod(F.xxhash64(key, vector), F.lit(blocks)).alias("b"), every(query_blocks).alias("s"), F.col(key).alias("k"), sent(vectors, vector).alias("v"))
    asked = queries.select(every(blocks).alias("b"), F.pmod(F.xxhash64(query_key, query_vector), F.lit(query_blocks)).alias("s"), F.col(query_key).alias("q"), sent(queries, query_vector).alias("v"))

    def best(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of(left, right, k, query_key, key)

    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, similarity double"
    scored = rows.groupBy("b", "s").cogroup(asked.groupBy("b", "s")).applyInPandas(best, kinds)
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(rows: pd.DataFrame, asked: pd.DataFrame, k: int, query_key: str, key: str) -> pd.DataFrame:
    """The k most similar of ``rows`` (k, v) to each of ``asked`` (q, v); equal ones by their keys."""
    rows = rows.sort_values("k", kind="stable")
    keys, vectors = rows["k"].to_numpy(), by_width(rows["v"])
    at_once, out = max(1, SCORES_AT_ONCE // max(1, len(rows))), []
    for at in range(0, len(asked), at_once) if len(rows) else ():
        part = asked.iloc[at : at + at_once]
        score = scored(by_width(part["v"]), vectors, len(part), len(rows))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out.append(pd.DataFrame({query_key: np.repeat(part["q"].to_numpy(), order.shape[1]), key: keys[order.ravel()], "similarity": np.take_along_axis(score, order, 1).ravel()}))
    return pd.concat(out) if out else pd.DataFrame({query_key: [], key: [], "similarity": []})


def cosine_matrix(a: Sequence, b: Sequence) -> np.ndarray:
    """``cosine_similarity`` of every vector of ``a`` with every one of ``b``; each pair is summed in
    one order, so equal vectors tie exactly."""
    return scored(by_width(a), by_width(b), len(a), len(b))


def by_width(vectors: Sequence) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of vectors but null and empty ones: their places, components and norms."""
    held = list(vectors)
    widths = np.array([-1 if x is None else len(x) for x in held])
    out = {}
    for width in set(widths.tolist()) - {-1, 0}:
        at = np.flatnonzero(widths == width)
        x = np.stack([held[n] for n in at]).astype(float)
        out[width] = at, x, np.sqrt((x * x).sum(1))
    return out


def scored(a: dict, b: dict, rows: int, columns: int) -> np.ndarray:
    """``cosine_matrix`` of vectors parted by length; vectors of different lengths score 0."""
    out = np.zeros((rows, columns))
    for width in a.keys() & b.keys():
        (i, x, left), (j, y, right) = a[width], b[width]
        scale = left[:, None] * right[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[np.ix_(i, j)] = np.where(scale <= 1e-12, 0.0, np.clip(np.einsum("id,jd->ij", x, y) / scale, -1, 1))
    return out
