"""Exact duplicates by content sort, with DataFrame functions only.

The normalised text (white space deleted) is dealt out by ranges: Spark samples
splitters over (first characters, 64-bit hash, salt), every task sorts its range
with Spark's external sort, and a window walks the sorted rows, comparing whole
neighbouring texts. The hash in the key keeps a common opening from filling one
range, and the salt does so for one very common text: texts that a sample shows to
be hot are dealt to ``salts`` ranges, each range elects its best row, and the few
elected rows (at most ``salts`` for each hot text) are compared again.

The row with the most code points in its original text stays, of those the one
with the smallest id (null ids last). Edge cases: a null text is empty, so all empty
and blank texts are one group; of wholly equal rows exactly one stays; very long texts are
compared whole; an empty table gives no rows; other columns pass through, with these columns added:
``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (replaced if present).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import SPACE_CLASS, carried, restored

#: Texts treated as hot: at most the 2048 most frequent of the sample, each seen this often. Any other
#: text thus holds less than one row in 2048, which one task sorts, spilling if need be.
HOT_TEXTS, HOT_SEEN = 2048, 4
SAMPLE = 0.01


def normalised(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"[{SPACE_CLASS}]+", "")


def hot_texts(docs: DataFrame, text_col: str, sample: float = SAMPLE, seed: int = 7) -> list[str]:
    """SHA-256 of normalised texts that are frequent in a sample; at most HOT_TEXTS."""
    seen = docs.select(text_col).sample(fraction=sample, seed=seed).groupBy(F.sha2(normalised(text_col).cast("binary"), 256).alias("h")).count()
    rows = seen.where(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "h").limit(HOT_TEXTS).collect()
    return [r["h"] for r in rows]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    own = [c for c in docs.columns if c not in added]
    hot = hot_texts(docs, text_col)
    keyed = docs.select(
        *carried(own),
        F.col(id_col).alias("_id"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_len"),
        normalised(text_col).alias("_norm"),
    ).withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
    is_hot = F.col("_sha").isin(hot) if hot else F.lit(False)
    keyed = keyed.select(
        "*",
        F.substring("_norm", 1, 8).alias("_head"),
        F.xxhash64("_norm").alias("_hash"),
        F.when(is_hot, F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(-1)).alias("_salt"),
    )
    key = ["_head", "_hash", "_norm", "_salt"]
    dealt = keyed.repartitionByRange("_head", "_hash", "_salt")
    group = Window.partitionBy(*key)
    best = group.orderBy(F.desc("_len"), F.asc_nulls_last("_id"))
    within = dealt.select(
        *(f"_own{i}" for i in range(len(own))), "_id", "_len", "_sha", "_salt",
        F.row_number().over(best).alias("_rank"),
        F.first("_id").over(best).alias("_keep"),
        F.count(F.lit(1)).over(group).alias("_size"),
    )
    out = restored(own)
    if not hot:
        return within.select(*out, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_rank") == 1).alias("kept"), F.col("_sha").alias("text_sha256"))
    # At most HOT_TEXTS x salts elected rows: always small enough to broadcast.
    elected = within.where((F.col("_salt") >= 0) & (F.col("_rank") == 1)).groupBy(F.col("_sha").alias("_hot")).agg(
        F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_salt").alias("s"))).alias("_win"),
        F.sum("_size").alias("_all"),
    )
    merged = within.join(F.broadcast(elected), (F.col("_sha") == F.col("_hot")) & (F.col("_salt") >= 0), "left")
    won = F.col("_hot").isNull() | (F.col("_salt") == F.col("_win.s"))
    return merged.select(
        *out,
        F.when(F.col("_hot").isNull(), F.col("_keep")).otherwise(F.col("_win.i")).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & won).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
