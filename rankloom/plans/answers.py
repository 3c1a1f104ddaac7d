"""A table of a model's answers by the prompt's digest: equal prompts are asked once, known ones never again.

Prompts are computed once and told apart by sha256. Those that the table doesn't hold are dealt out evenly and asked in
groups of ``group``, once, and once more with ``retry`` where the answer doesn't fit; a task stops asking after ``most_calls``
calls or ``seconds``. The answers land in a table in buckets (an upsert of touched buckets), so a run that was cut
short, or is repeated, asks only what is still open. A prompt whose call failed, or that was not reached, stays open
and has a null answer in this run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.buckets import is_bucketed, looked_up, next_batch, upsert_buckets
from rankloom.session import checkpointed

#: A model takes prompts and gives an answer, or None, for each.
Model = Callable[[list[str]], list[str | None]]


def _asked(model: Model, prompts: list[str], fits: Callable[[str | None], bool], again: Callable[[str, str | None], str], left: Callable[[], bool]) -> list[tuple[str | None, int]]:
    """Answer and number of tries of each prompt; (None, 0) for a failed call."""
    answers = model(prompts)
    if len(answers) != len(prompts):
        raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    out = [(a, 1) for a in answers]
    bad = [i for i, a in enumerate(answers) if not fits(a)]
    if bad and left():
        second = model([again(prompts[i], answers[i]) for i in bad])
        for i, a in zip(bad, second, strict=True):
            out[i] = (a, 2)
    return out


def answered_prompts(df: DataFrame, prompt: Column, key: str, model: Model, path: str, fits: Callable[[str | None], bool], again: Callable[[str, str | None], str], group: int = 16, most_calls: int | None = None, seconds: float | None = None, tasks: int | None = None, buckets: int = 64) -> DataFrame:
    """``key``, ``answer`` and ``tries`` for each row of ``df``; a null prompt has no answer. New answers are in ``path`` when this returns."""
    spark = df.sparkSession
    prompts = checkpointed(df.select(key, prompt.alias("prompt")).withColumn("digest", F.sha2("prompt", 256)))
    open_ = prompts.where("digest IS NOT NULL").select("digest", "prompt").dropDuplicates(["digest"])
    if is_bucketed(spark, path):
        open_ = open_.join(looked_up(spark, path, prompts.where("digest IS NOT NULL").select("digest"), ["digest"]).select("digest"), "digest", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, calls = time.monotonic(), 0
        left = lambda: (most_calls is None or calls < most_calls) and (seconds is None or time.monotonic() - began < seconds)

        def counted(these: list[str]) -> list[str | None]:
            nonlocal calls
            calls += 1
            return model(these)

        for batch in batches:
            for at in range(0, batch.num_rows, group):
                if not left():
                    return
                part = batch.slice(at, group)
                try:
                    told = _asked(counted, part.column("prompt").to_pylist(), fits, again, left)
                except Exception:  # a failed call leaves its prompts open
                    continue
                kept = [i for i, (a, _) in enumerate(told) if a is not None]
                yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(kept, pa.int64())), pa.array([told[i][0] for i in kept], pa.string()), pa.array([told[i][1] for i in kept], pa.int32())], names=["digest", "answer", "tries"])

    dealt = open_.repartition(tasks or spark.sparkContext.defaultParallelism, "digest")
    new = dealt.mapInArrow(ask, "digest string, answer string, tries int")
    upsert_buckets(new, path, ["digest"], next_batch(spark, path), buckets)
    if not is_bucketed(spark, path):  # nothing has ever been answered
        return prompts.select(key, F.lit(None).cast("string").alias("answer"), F.lit(0).alias("tries"))
    known = looked_up(spark, path, prompts.where("digest IS NOT NULL").select("digest"), ["digest"])
    return prompts.select(key, "digest").join(known, "digest", "left").select(key, "answer", F.coalesce("tries", F.lit(0)).alias("tries"))
