"""The work queue as streams: bounded intake, idempotent batches, changes of state, running job status.

The daily counts are an extension of the queue itself, which has no event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from rankloom.operators.buckets import upsert_buckets
from rankloom.operators.ranking import latest
from rankloom.schemas import QUEUE_STATES

#: States after which an item may be forgotten.
FINISHED = ("completed", "failed")
#: Where states of arbitrary shape are kept.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Work items as they land as Parquet files; intake is bounded for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, keys: list[str], checkpoint: str, every: str = "2.5 seconds", available_now: bool = False, order: str | None = None, buckets: int = 64) -> DataStreamWriter:
    """Runs ``work`` on each batch and upserts its rows into ``target``, a table in ``buckets`` of ``keys``: only the
    buckets that a batch touches are rewritten, and a batch that is run again after a crash skips those it had finished. Of several
    rows of a key in a batch the last by ``order`` wins; without one, rows of a key must not repeat within a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        upsert_buckets(work(rows), target, keys, number, buckets, order)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def status_changes(events: DataFrame, job: str = "user_id", item: str = "event_id", state: str = "event_type", at: str = "ts", tie: Sequence[str] = (), keep: str | None = None, late: str = "1 hour", parts: int = 16) -> DataFrame:
    """One row for each change of an item's state: job, item, ``from_status`` (null at first), ``to_status``, ``at``.

    An item's events are ordered by ``at``, then by the columns ``tie``, then by state; one without a state or time
    changes nothing. With ``keep`` (an interval) a finished item (completed or failed) is forgotten that long after its
    last event: a later event begins anew, from null.

    A table and a stream follow the same rule. As a stream, events wait until the watermark (``late`` behind
    the newest) has passed them and are then taken in their order, so what comes late within that time
    is put in its place and what comes later still is dropped, with ``at`` a timestamp. A job's items are dealt out
    to ``parts`` states, each a map of its items' last states and the events that wait; timers at the watermark release events
    and remove forgotten items. The session is set to keep such state in RocksDB.
    """
    kind = lambda c: events.schema[c].dataType.simpleString()
    rows = events.select(job, item, F.col(state).alias("to_status"), F.col(at).alias("at"), F.struct(*(F.col(c) for c in tie), F.col(state)).alias("_tie")).where("to_status IS NOT NULL AND at IS NOT NULL")
    if not events.isStreaming:
        order = Window.partitionBy(job, item).orderBy("at", "_tie")
        before, since = F.lag("to_status").over(order), F.lag("at").over(order)
        if keep:
            over = F.col("at") > since + F.expr(f"INTERVAL {keep}")
            before = F.when(before.isin(*FINISHED) & over, None).otherwise(before)
        changed = rows.select(job, item, before.alias("from_status"), "to_status", "at")
        return changed.where("from_status IS NULL OR from_status <> to_status")

    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = rows.withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late)
    dealt = timed.select(F.col(job).alias("job"), F.pmod(F.xxhash64(item), F.lit(parts)).alias("part"), F.coalesce(F.concat(F.lit("="), F.col(item).cast("string")), F.lit("")).alias("item"), "to_status", F.unix_micros("_at").alias("us"), *(_sortable(F.col(f"_tie.{c}"), kind(c)).alias(f"t{i}") for i, c in enumerate(tie)), "_at")
    micros = None if keep is None else spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {keep}")).alias("n")).first()["n"]
    done = dealt.groupBy("job", "part").transformWithStateInPandas(ItemStates(len(tie), micros), f"job {kind(job)}, item string, from_status string, to_status string, us bigint", "Append", "EventTime")
    back = F.when(F.col("item") != "", F.substr("item", F.lit(2))).cast(kind(item))
    return done.select(F.col("job").alias(job), back.alias(item), "from_status", "to_status", F.timestamp_micros("us").cast(kind(at)).alias("at"))


def _sortable(value: Column, kind: str) -> Column:
    """A text that sorts as the value does (pandas would turn integers with nulls into floats)."""
    if kind == "string":
        return value
    if kind.startswith("timestamp"):
        value = F.unix_micros(value.cast("timestamp"))
    elif kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"a tie is told by a text, an integer or a time, not by {kind}")
    return F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


class ItemStates(StatefulProcessor):
    """The last states of a part of a job's items, and the events that wait for the watermark."""

    def __init__(self, ties: int, keep: int | None):
        self.keep = keep
        self.columns = ["item", "to_status", "us", *(f"t{i}" for i in range(ties))]
        #: Forgotten items are looked for at most four times in the time they are kept (ms).
        self.step = max(1, (keep or 0) // 4000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "item string", "status string, us bigint")
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {'bigint' if c == 'us' else 'string'}" for c in self.columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[self.columns] for r in rows])
        if len(new):
            self.waiting.appendList([(*r[:2], int(r[2]), *r[3:]) for r in new.itertuples(index=False)])
            self._call(int(new["us"].min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        released, rest, forget = [], [], self.keep is not None and expiredTimerInfo.getExpiryTimeInMs() % self.step == 0
        for r in self.waiting.get():
            (released if r[2] <= watermark * 1000 else rest).append(tuple(r))
        if released:
            if rest:
                self.waiting.put(rest)
                self._call(min(r[2] for r in rest))
            else:
                self.waiting.clear()
        out = []
        for r in sorted(released, key=self._order):
            item, to, us = r[:3]
            now, since = self.last.getValue((item,)) if self.last.containsKey((item,)) else (None, None)
            if self.keep is not None and now in FINISHED and us > since + self.keep:
                now = None
            if to != now:
                out.append((key[0], item, now, to, us))
            self.last.updateValue((item,), (to, us))
            if self.keep is not None and to in FINISHED:
                due = (us + self.keep) // 1000 + 1
                if due < watermark:
                    forget = True
                else:
                    self.handle.registerTimer(-(-due // self.step) * self.step)
        if forget:
            self._forget(watermark)
        if out:
            yield pd.DataFrame(out, columns=["job", "item", "from_status", "to_status", "us"])

    def close(self) -> None:
        pass

    def _call(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _forget(self, watermark: int) -> None:
        gone = [k for k, (status, us) in self.last.iterator() if status in FINISHED and us + self.keep < watermark * 1000]
        for k in gone:
            self.last.removeKey(k)

    def _order(self, row: tuple) -> tuple:
        """Time, then ties with nulls first, as in a table."""
        return (row[2], *((v is not None, v) for v in (*row[3:], row[1])))


def status_counts(changes: DataFrame, job: str = "user_id") -> DataFrame:
    """``running_status`` from landed changes: each adds to one counter and takes from another."""
    is_ = lambda c, s: F.coalesce((F.col(c) == s).cast("long"), F.lit(0))
    return changes.groupBy(job).agg(F.count_if(F.col("from_status").isNull()).alias("total"), *(F.sum(is_("to_status", s) - is_("from_status", s)).alias(s) for s in QUEUE_STATES))


def running_status(events: DataFrame, job: str = "user_id", item: str = "event_id", state: str = "event_type", at: str = "ts") -> DataFrame:
    """Counters of each job over the latest state of each of its items; for ``foreachBatch`` or a table."""
    now = latest(events, [job, item], F.desc(at))
    return now.groupBy(job).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(state) == s).alias(s) for s in QUEUE_STATES))


def daily_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Events of each kind by day, with a watermark; the same plan serves a table."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(at, "1 day"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("day"), kind, "n")
