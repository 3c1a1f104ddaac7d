"""Mixing sources to target weights by hash order and prefix sums, in SQL functions only.

Every row gets a hash-random key; within a source, rows lie in key order. The key's
first hex digits cut each source into ranges, so a source with a third of all rows
is sorted by thousands of tasks: range totals are summed first (one small row for
each source and range), their prefix sums are joined back, and each range adds its
own running sum. Rows of one id (or of no id) share a key: an id that a sample of the rows shows to hold more than ``HOT_ROWS``
has ranges of its own, by size and a hash of the row, which keeps the order and splits it. A source's budget is its target in words: whole epochs while it
exceeds the source, then documents in key order up to the exact word.

Targets: sources in code point order (null last) take the weights in turn and share
all words by weight; a target stops at ``max_epochs`` times its source, and the
excess is shared again, which is a water level found in closed form: with sources
in order of cap over weight, the first level at or below its own source's ratio.

Edge cases: a null text has no words; a null source is a source of its own; a source
without words has target 0; rows without words take 0; very long texts are counted whole; equal ids share a key and are
ordered by size, so reruns agree; an empty table gives no rows; other columns pass
through, ``size``, ``source_size``, ``target`` and ``taken`` are replaced if present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import SPACE_CLASS, carried, restored, staged

#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
#: Rows of one id that are split, the share of rows that is looked at for such ids, ids that can be split, and ranges a size.
HOT_ROWS, SAMPLED, MOST_HOT, SPLITS = 50_000, 1 / 16, 1024, 256


def hot_keys(keyed: DataFrame) -> list[str]:
    """Keys that hold very many rows, by a sample: it decides on ranges, not on results."""
    seen = keyed.where(F.rand(3) < SAMPLED).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS * SAMPLED)
    return sorted(r["_key"] for r in seen.orderBy(F.desc("n"), "_key").limit(MOST_HOT).collect())


def range_of(key: Column, size: Column, row: Column, hot: list[str]) -> Column:
    """Name of the range that a row lies in; names sort as (key, size) does."""
    digits = F.substring(key, 1, RANGE_DIGITS)
    if not hot:
        return digits
    keys = F.array(*map(F.lit, hot))
    below = F.lpad(F.size(F.filter(keys, lambda h: h < key)).cast("string"), 4, "0")
    own = F.concat(F.lit("="), F.lpad(size.cast("string"), 20, "0"), F.lpad(F.pmod(row, F.lit(SPLITS)).cast("string"), 3, "0"))
    return F.concat(digits, below, F.when(F.array_contains(keys, key), own).otherwise(""))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words)."""
    added = ("size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c not in added]
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"[^{SPACE_CLASS}]+"))
    keyed = docs.select(
        *carried(own),
        F.col(id_col).alias("_id"),
        F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("_source"),
        words.cast("long").alias("_size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_key"),
        F.xxhash64(*(F.col(f"`{c}`") for c in own)).alias("_row"),
    )
    keyed = keyed.withColumn("_range", range_of(F.col("_key"), F.col("_size"), F.col("_row"), hot_keys(keyed))).drop("_row")
    ranges = staged(keyed.groupBy("_source", "_range").agg(F.sum("_size").alias("_words")), "mix-ranges")
    before = Window.partitionBy("_source").orderBy("_range")
    starts = ranges.select(
        F.col("_source").alias("_s"),
        F.col("_range").alias("_r"),
        (F.sum("_words").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")).alias("_start"),
    )
    budgets = source_targets(ranges.groupBy("_source").agg(F.sum("_words").alias("_total")), weights, max_epochs)
    plan = starts.join(budgets, starts["_s"] == budgets["_source"]).drop("_source")
    running = F.sum("_size").over(Window.partitionBy("_source", "_range").orderBy("_key", F.asc_nulls_last("_id"), "_size").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("_upto", running).join(plan, (F.col("_source") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor(F.col("_target") + 0.5).cast("long")
    epochs = F.when(F.col("_total") > 0, F.expr("floor(_target + 0.5) div _total")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("_total") - F.col("_start") - F.col("_upto") + F.col("_size")
    return placed.select(
        *restored(own),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (epochs * F.col("_size") + F.greatest(F.lit(0), F.least(rest, F.col("_size")))).cast("long").alias("taken"),
    )


def source_targets(totals: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``totals`` (_source, _total; one row a source) with ``_target``."""
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    turn = F.row_number().over(Window.orderBy((F.col("_source") == "").cast("int"), "_source")) - 1
    weighed = totals.withColumn("_weight", F.element_at(kinds, (turn % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("_total") * max_epochs)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    upto, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("_total").over(everything) - F.sum("_cap").over(upto) + F.col("_cap")) / (F.sum("_weight").over(everything) - F.sum("_weight").over(upto) + F.col("_weight"))
    levels = weighed.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.struct((F.col("_cap") / F.col("_weight")).alias("r"), "_source", "_level"))).over(everything)
    return levels.withColumn("_target", F.least(F.col("_cap").cast("double"), F.coalesce(fits["_level"], F.lit(0.0)) * F.col("_weight"))).select("_source", "_total", "_target")
