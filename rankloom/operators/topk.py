"""Exact top-k by cosine with pruning: clusters that cannot hold a better row are not read for a query.

Rows are dealt to the nearest of a bounded number of centres (fitted on a bounded sample); a cluster's radius covers all its
rows. On unit vectors a cosine is a distance, and by the triangle inequality no row of a cluster is nearer to a query than
its centre's distance less the radius. A query first meets its nearest clusters that hold k rows together, which gives a
k-th similarity, and then those clusters only whose bound reaches it. So the result is that of ``similar_for_each``; how many
pairs are scored depends on the data: few where vectors lie in clusters, nearly all where they are isotropic.

What is not regular is kept exact by other means: rows of no or zero length, of non-finite components, or of another
length than the most common one, and queries like that, are scored without pruning (rows that have similarity 0 with
every regular query only as far as they can be among the k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.ranking import best_of, similar_for_each
from rankloom.session import checkpointed

#: What rounding may take from a bound.
SLACK = 1e-9
LEAST_NORM, MOST_NORM = 1e-6, 1e150


def _regular(v: Column, width: int) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce((F.size(v) == F.lit(width)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & norm.between(LEAST_NORM, MOST_NORM), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fitted_centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors, by alternating assignment and means."""
    rng = np.random.default_rng(5)
    centres = sample[rng.permutation(len(sample))[:clusters]]
    for _ in range(rounds):
        at = (sample @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def similar_pruned(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "resume_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_embedding", clusters: int = 1024, sample_rows: int = 20_000, block_rows: int = 8192, query_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The rows of ``similar_for_each`` (query, key, similarity, rank), and for each query how many rows were ``scored``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    sized = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sized["n"] if sized else 0
    plain = rows.where(_regular(F.col("v"), width))
    total = plain.count()
    regular = checkpointed(asked.where(_regular(F.col("v"), width)).withColumn("n", F.monotonically_increasing_id()))
    odd = asked.where(~_regular(F.col("v"), width))
    everything = {"k": k, "key": "k", "vector": "v", "query_key": "q", "query_vector": "v"}
    found = [similar_for_each(rows, odd, **everything).select("q", "k", "similarity")]
    scored = [odd.select("q", F.lit(rows.count()).alias("scored"))]
    # Rows of similarity 0 with every regular query: only the k smallest keys can be among its k. Others of this length are rare and always scored.
    nought = rows.where((F.coalesce(F.size("v"), F.lit(-1)) != width) | F.col("v").isNull()).orderBy("k").limit(k)
    rare = rows.where((F.size("v") == width) & ~_regular(F.col("v"), width))
    beside = checkpointed(nought.unionByName(rare))
    n_beside = beside.count()
    if total:
        share = min(1.0, sample_rows / total)
        drawn = plain.where(F.pmod(F.xxhash64("k", "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").limit(2 * sample_rows).collect()
        drawn = drawn or plain.select("v").limit(1).collect()
        sample = np.array(sorted(r["v"] for r in drawn), float)
        centres = fitted_centres(sample / np.sqrt((sample * sample).sum(1, keepdims=True)), max(1, min(clusters, int(total**0.5))))
        visited, met = _visited(spark, plain, regular, beside if n_beside else None, centres, k, block_rows, query_rows)
        found.append(visited)
        scored.append(met.select("q", (F.col("scored") + n_beside).alias("scored")))
    elif n_beside:
        found.append(similar_for_each(beside, regular.select("q", "v"), **everything).select("q", "k", "similarity"))
        scored.append(regular.select("q", F.lit(n_beside).alias("scored")))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), F.asc("k"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    counted = scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
    return best.select(F.col("q").alias(query_key), F.col("k").alias(key), "similarity", "rank"), counted.select(F.col("q").alias(query_key), "scored")


def _visited(spark, plain: DataFrame, asked: DataFrame, beside: DataFrame | None, centres: np.ndarray, k: int, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """The k best of each query (n, q, v) among the regular rows and those ``beside`` them, and the rows scored."""
    shared = spark.sparkContext.broadcast(centres)
    kind = plain.schema["k"].dataType.simpleString()
    q_kind = asked.schema["q"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("v"))
                at = _distances(x, shared.value).argmin(1)
                apart = np.sqrt(((x - shared.value[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(apart)], names=["k", "v", "c", "apart"])

    dealt = checkpointed(plain.mapInArrow(deal, f"k {kind}, v array<double>, c int, apart double"))
    told = dealt.groupBy("c").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()  # a row a centre
    held, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in told:
        held[r["c"]], radius[r["c"]] = r["rows"], r["radius"]
    cluster = spark.sparkContext.broadcast((centres, held, radius))
    splits = spark.createDataFrame([(r["c"], -(-r["rows"] // block_rows)) for r in told], "c int, splits long")
    query_blocks = max(1, -(-asked.count() // query_rows))

    def plan(first: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, held, radius = cluster.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = _distances(_unit(batch.column("v")), centres)
                far[:, held == 0] = np.inf
                near = np.argsort(far, axis=1, kind="stable")
                count = (np.cumsum(held[near], axis=1) < k).sum(1) + 1  # the nearest that hold k rows together
                place = np.argsort(near, axis=1, kind="stable")
                begins = (place < count[:, None]) & (held > 0)
                if first:
                    chosen = begins
                else:
                    least = batch.column("least").to_numpy(zero_copy_only=False)
                    reach = 1 - np.maximum(far - radius - SLACK, 0) ** 2 / 2 + SLACK
                    chosen = ~begins & (held > 0) & ~(reach < least[:, None])  # a null bound (fewer than k so far) opens all
                lists = [np.flatnonzero(c).astype(np.int32) for c in chosen]
                met = [int(held[c].sum()) for c in lists]
                yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("q"), batch.column("v"), pa.array(lists, pa.list_(pa.int32())), pa.array(met, pa.int64())], names=["n", "q", "v", "cs", "met"])

        return task

    out = f"n long, q {q_kind}, v array<double>, cs array<int>, met long"

    def scored(planned: DataFrame) -> DataFrame:
        """(n, q, k, similarity): the k best of every query in every block of a cluster that it meets."""
        turn = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        pairs = planned.select("n", "q", "v", F.explode("cs").alias("c")).join(F.broadcast(splits), "c").select("n", "q", "v", "c", turn(F.col("splits")).alias("s"), F.pmod("n", F.lit(query_blocks)).alias("t"))
        wanted = F.broadcast(planned.select(F.explode("cs").alias("c")).distinct())  # no more than there are centres
        own = dealt.join(wanted, "c", "left_semi").join(F.broadcast(splits), "c").select("c", F.pmod(F.xxhash64("k"), "splits").alias("s"), turn(F.lit(query_blocks).cast("long")).alias("t"), "k", "v")

        def best(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return best_of(left, right.assign(q=right["n"]), k, "n", "k")

        met = own.groupBy("c", "s", "t").cogroup(pairs.groupBy("c", "s", "t")).applyInPandas(best, f"n long, k {kind}, similarity double")
        return met

    begun = checkpointed(asked.mapInArrow(plan(True), out))
    kept = checkpointed(scored(begun))
    if beside is not None:
        kept = kept.unionByName(similar_for_each(beside, asked.select("n", "v"), k=k, key="k", vector="v", query_key="n", query_vector="v").select("n", "k", "similarity"))
    order = Window.partitionBy("n").orderBy(F.desc("similarity"), F.asc("k"))
    least = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("n", F.col("similarity").alias("least"))
    rest = checkpointed(asked.join(least, "n", "left").mapInArrow(plan(False), out))
    every = kept.unionByName(scored(rest)).join(asked.select("n", "q"), "n").select("q", "k", "similarity")
    met = begun.select("n", "q", "met").join(rest.select("n", F.col("met").alias("more")), "n").select("q", (F.col("met") + F.col("more")).alias("scored"))
    return every, met
