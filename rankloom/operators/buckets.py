"""Tables in hash buckets of their key: a batch rewrites the buckets it touches and no other file.

A table is a folder of Parquet files partitioned by ``_bucket``, a hash of the key. An upsert reads the buckets that
its keys fall into (partition pruning), joins the batch to them and overwrites just these partitions. Every
row of a bucket carries the number of the batch that wrote it: a batch that runs again after a crash skips
the buckets it had finished, and one that had finished altogether is a no-op. Batches come in the order of their numbers, from
one writer at a time. Spark's commit removes a bucket's old files right before it moves the new ones in place; those
of a commit that is cut short between the two lie in its staging folder below the table.

The number of buckets is fixed when the table is made; a bucket should hold some hundred MB. A bucket larger than
a task should take is read by many tasks and written by many (adaptive rebalancing splits it). The first batch of a table
meets nothing stored: its rows are dealt to their buckets once and written from there, without being staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.ranking import latest
from rankloom.operators.store import upserted
from rankloom.session import staged_rows

BUCKET, BATCH, OF = "_bucket", "_batch", "_buckets"
#: Put before the keys where parts of a bucket are told, so they don't follow from it.
PART_SEED = 7


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A null key has a bucket, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _present(spark: SparkSession, path: str) -> list[int]:
    """The buckets that hold rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix(f"{BUCKET}=")) for n in names if n.startswith(f"{BUCKET}="))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _present(spark, path) else None


def stored_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns of a bucketed table; none where there is no table yet."""
    found = _stored(spark, path)
    return [] if found is None else found.drop(BUCKET, BATCH, OF).columns


def is_bucketed(spark: SparkSession, path: str) -> bool:
    return _stored(spark, path) is not None


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a bucketed table."""
    found = _stored(spark, path)
    if found is None:
        raise FileNotFoundError(f"no buckets in {path}")
    return found.drop(BUCKET, BATCH, OF)


def looked_up(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows of the keys of ``wanted``; only their buckets are read."""
    found = _stored(spark, path)
    if found is None:
        raise FileNotFoundError(f"no buckets in {path}")
    buckets = found.select(OF).first()[OF]
    touched = [r["b"] for r in wanted.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    return found.where(F.col(BUCKET).isin(touched)).join(wanted.select(*keys).distinct(), keys, "left_semi").drop(BUCKET, BATCH, OF)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the last one that has written; for writers whose batches have no numbers of their own."""
    found = _stored(spark, path)
    last = found.agg(F.max(BATCH)).first()[0] if found is not None else None
    return 0 if last is None else last + 1


def _finished(found: DataFrame, batch: int, buckets: int) -> bool:
    """Whether every bucket was written by ``batch`` or a later one."""
    last = found.groupBy(BUCKET).agg(F.max(BATCH).alias("last"), F.max(OF).alias("of"))
    n, least, of = last.agg(F.count(F.lit(1)), F.min("last"), F.max("of")).first()
    return n == buckets == of and least >= batch


def _put(rows: DataFrame, path: str, batch: int, buckets: int) -> None:
    """Writes rows (with their buckets) over the buckets they name."""
    numbered = rows.withColumns({BATCH: F.lit(batch).cast("long"), OF: F.lit(buckets)})
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _dealt(rows: DataFrame, keys: list[str], within: list[str], buckets: int, order: str | None) -> DataFrame:
    """One row of each key with its bucket, behind one shuffle: a bucket is dealt in parts by the same hash, so that many tasks write it."""
    parts = max(1, -(-4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    placed = rows.withColumns({BUCKET: bucket_of(within, buckets), "_part": F.pmod(F.xxhash64(F.lit(PART_SEED), *within), F.lit(parts))})
    at = [BUCKET, "_part", *keys]
    own = placed.repartition(BUCKET, "_part")
    return (latest(own, at, F.desc(order)) if order else own.dropDuplicates(at)).drop("_part")


def upsert_buckets(rows: DataFrame, path: str, keys: list[str], batch: int, buckets: int = 64, order: str | None = None, keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), within: list[str] | None = None) -> list[int]:
    """Upserts ``rows`` by ``keys`` as ``upserted`` does and returns the buckets it has rewritten.

    ``rows`` are computed once. Buckets that batch ``batch`` or a later one has written already are left alone. With ``within``, some of
    the keys, rows that agree in them share a bucket; a table keeps to what it was made with.
    """
    spark, within = rows.sparkSession, within or keys
    stored = _stored(spark, path)
    if stored is None:
        _put(_dealt(rows, keys, within, buckets, order), path, batch, buckets)
        return _present(spark, path)
    if _finished(stored, batch, buckets):
        rows.select(bucket_of(within, buckets).alias(BUCKET)).distinct().count()  # what observes the rows sees them; nothing is staged
        return []
    with staged_rows(rows.withColumn(BUCKET, bucket_of(within, buckets)), "upsert") as new:
        touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets``
        held = stored.select(OF).first()[OF]
        if held != buckets:
            raise ValueError(f"{path} has {held} buckets, not {buckets}")
        near = stored.where(F.col(BUCKET).isin(touched))
        done = {r[BUCKET]: r["last"] for r in near.groupBy(BUCKET).agg(F.max(BATCH).alias("last")).collect()}
        todo = [b for b in touched if done.get(b, batch - 1) < batch]
        if not todo:
            return []
        present = stored.where(F.col(BUCKET).isin(todo)).drop(BUCKET, BATCH, OF)
        merged = upserted(present, new.where(F.col(BUCKET).isin(todo)).drop(BUCKET), keys, keep=keep, fill=fill, order=order)
        _put(merged.withColumn(BUCKET, bucket_of(within, buckets)).hint("rebalance", F.col(BUCKET)), path, batch, buckets)
    return todo
