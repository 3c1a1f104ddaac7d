"""Events of the screening pipeline as rows, and their counts as metrics observed on the way.

An event table has one row for each thing that happens to a résumé: it is queued, started, takes a step (extracting,
analyzing), its pages are extracted, it fails, or its analysis is complete. The rows follow from what extraction and
analysis return, in one pass; ``place`` orders a résumé's events. Landing them is an upsert by id, so a batch that
runs again adds nothing. An event's id is a digest of its job, résumé, place and kind, so the table is kept by these four, in buckets of
résumés, and holds no digests; ``read_events`` gives them back. Counts are taken by ``observe`` while events are written; as a stream, a
listener notes them for each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from rankloom.operators.buckets import read_buckets, stored_columns, upsert_buckets

# Names of the events.
QUEUED, STARTED, STEP = "resume-queued", "resume-processing-started", "resume-processing-step"
EXTRACTED, FAILED, COMPLETE = "resume-extraction-completed", "resume-processing-failed", "candidate-analysis-complete"
KINDS = (QUEUED, STARTED, STEP, EXTRACTED, FAILED, COMPLETE)

#: What an event's id is made of.
KEY = ["job_id", "resume_id", "place", "event"]
_DETAIL = {"step": "string", "pages": "int", "text_pages": "int", "ocr_pages": "int", "method": "string", "duration_ms": "bigint", "error": "string", "candidate_id": None, "overall_score": "double"}


def pipeline_events(queued: DataFrame, extractions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Events (id, resume_id, job_id, place, event and what each says) of queue entries (resume_id, job_id), extractions (resume_id,
    job_id, method, text_pages, ocr_pages, total_pages, duration_ms, error) and analyses (resume_id, candidate_id, overall_score).

    A file without pages has no extraction event; a failed extraction ends a résumé's events.
    """
    kinds = {**_DETAIL, "candidate_id": analyses.schema["candidate_id"].dataType.simpleString()}

    def event(place: int, kind: str, **said: Column) -> Column:
        rest = [(said[n] if n in said else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("event"), *rest)

    failed = F.col("error").isNotNull()
    met = extractions.join(analyses.select("resume_id", "candidate_id", "overall_score", F.lit(True).alias("_done")), "resume_id", "left")
    told = F.array_compact(F.array(
        event(1, STARTED),
        event(2, STEP, step=F.lit("extracting")),
        F.when(failed, event(3, FAILED, error=F.col("error"))),
        F.when(~failed & F.col("total_pages").isNotNull(), event(3, EXTRACTED, pages=F.col("total_pages"), text_pages=F.col("text_pages"), ocr_pages=F.col("ocr_pages"), method=F.col("method"), duration_ms=F.col("duration_ms"))),
        F.when(~failed, event(4, STEP, step=F.lit("analyzing"))),
        F.when(~failed & F.col("_done"), event(5, COMPLETE, candidate_id=F.col("candidate_id"), overall_score=F.col("overall_score"))),
    ))
    waiting = queued.select("resume_id", "job_id", event(0, QUEUED).alias("e"))
    rows = waiting.unionByName(met.select("resume_id", "job_id", F.explode(told).alias("e"))).select("resume_id", "job_id", "e.*")
    return _named(rows)


def _named(events: DataFrame) -> DataFrame:
    return events.select(F.sha2(F.concat_ws(":", *KEY), 256).alias("id"), *events.columns)


def counts() -> list[Column]:
    """How many events of each kind, as ``observe`` takes them."""
    return [F.count_if(F.col("event") == k).alias(k) for k in KINDS]


def _upsert(events: DataFrame, path: str, batch: int, buckets: int) -> None:
    """Events without the four columns, and those of a table that holds ids, are kept by id."""
    if {"id", *KEY} <= set(events.columns) and "id" not in stored_columns(events.sparkSession, path):
        upsert_buckets(events.drop("id"), path, KEY, batch, buckets, within=["resume_id"])
    else:
        upsert_buckets(events, path, ["id"], batch, buckets)


def land_events(events: DataFrame, path: str, batch: int, buckets: int = 64) -> dict[str, int]:
    """Upserts events by id into the event table and returns how many of each kind the batch held."""
    seen = Observation("events")
    _upsert(events.observe(seen, *counts()), path, batch, buckets)
    return {k: int(n) for k, n in seen.get.items()}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an event table, with their ids."""
    found = read_buckets(spark, path)
    return found if "id" in found.columns else _named(found)


def event_stream(events: DataFrame, path: str, checkpoint: str, name: str = "events", buckets: int = 64, available_now: bool = False, every: str = "2.5 seconds") -> DataStreamWriter:
    """Lands a stream of events; each batch's counts are observed as ``name`` (see ``EventCounts``)."""
    writer = events.observe(name, *counts()).writeStream.foreachBatch(lambda rows, number: _upsert(rows, path, number, buckets)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


class EventCounts(StreamingQueryListener):
    """Counts of each kind by query run and batch, as the batches end."""

    def __init__(self, name: str = "events"):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event: StreamingQueryListener.QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: StreamingQueryListener.QueryProgressEvent) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[str(event.progress.runId), event.progress.batchId] = found.asDict()

    def onQueryTerminated(self, event: StreamingQueryListener.QueryTerminatedEvent) -> None:
        pass

    def total(self) -> dict[str, int]:
        return {k: sum(b.get(k) or 0 for b in self.batches.values()) for k in KINDS}
