"""What the operators of this subpackage share: tables, staging and folds."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows that a task turns into Python objects at a time. Spark bounds the bytes of a batch
#: (spark.sql.execution.arrow.maxBytesPerBatch), this bounds what is made of them.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; a null id is empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % buckets


def carried(names: list[str]) -> list[Column]:
    """Columns under names of our own, so that no name of the caller's clashes with a step's."""
    return [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(names)]


def restored(names: list[str]) -> list[Column]:
    return [F.col(f"_own{i}").alias(c) for i, c in enumerate(names)]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows (views, not copies)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.

    Only where driver and executors are one process (a local master) and the setting is
    missing, a temporary folder of this machine is taken and recorded there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="rankloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Staged tables by owner: the process, then each open ``staging`` block.
_owners: list[list[str]] = [[]]


def tables_mark() -> int:
    return len(_owners[-1])


def tables_since(mark: int) -> list[str]:
    """The tables that the present owner has staged since the mark."""
    return _owners[-1][mark:]


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes staged tables; nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        for owned in _owners:
            if path in owned:
                owned.remove(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside belong to this block and are removed at its end."""
    _owners.append([])
    try:
        yield
    finally:
        drop_tables(spark, _owners[-1])
        _owners.pop()


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: what follows survives the loss of any executor without
    computing ``df`` again, and several readers share one computation. The table lives
    until its operator or ``staging`` block drops it, at most as long as the driver. A
    ``lasting`` one belongs to what is around the present block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rankloom-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    _owners[-2 if lasting and len(_owners) > 1 else -1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="rankloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "rankloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
