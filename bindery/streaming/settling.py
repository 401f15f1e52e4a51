"""Streams of folder sightings: settled files, holds until tomorrow, news told once.

Processing-time polling becomes a stream of (path, mark, at) sightings; state is kept by
path. ``settle_stream`` emits a path when its mark was seen often enough in a row;
``once_per_mark`` lets a (path, mark) through once; ``HoldUntilTomorrow`` keeps a book back
until the next UTC day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGHTINGS = "path string, mark string, at timestamp"


def settle_stream(sightings: DataFrame, checks: int = 2, forget_after: str | None = None) -> DataFrame:
    """(path, mark, streak): a row for each sighting that makes or keeps a path settled.

    A changed mark starts the count again; with ``forget_after``, a path that is not seen for
    so much processing time is forgotten, as a file that left the folder. Such a stream has
    always another batch to run, so it can't be drained by ``availableNow``.
    """
    milliseconds = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark, streak = state.get if state.exists else (None, 0)
        seen = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for now in seen["mark"]:
            streak = streak + 1 if now == mark else 1
            mark = now
            if streak >= checks:
                out.append((key[0], mark, streak))
        state.update((mark, streak))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        if out:
            yield pd.DataFrame(out, columns=["path", "mark", "streak"])

    return sightings.groupBy("path").applyInPandasWithState(
        step, "path string, mark string, streak long", "mark string, streak long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout,
    )


def once_per_mark(rows: DataFrame) -> DataFrame:
    """Rows of a stream, the first for each path and mark."""
    return rows.dropDuplicates(["path", "mark"])


def hold_until_tomorrow(attempts: DataFrame) -> DataFrame:
    """(path, at, failed) of a stream -> attempts that are made: after one that failed, none
    for the rest of its UTC day.

    Times go to pandas as microseconds and their days as text: its own times end in 2262, and
    are in the session's zone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        out = []
        for at, day, failed in pd.concat(list(batches)).sort_values("at", kind="stable")[["at", "day", "failed"]].itertuples(index=False):
            if day == held:
                continue
            out.append((key[0], at, bool(failed)))
            held = day if failed else ""
        state.update((held,))
        if out:
            yield pd.DataFrame(out, columns=["path", "at", "failed"])

    at = F.col("at").cast("timestamp")
    day = F.date_from_unix_date(F.floor(F.unix_seconds(at) / 86400).cast("int")).cast("string")
    told = attempts.select("path", F.unix_micros(at).alias("at"), day.alias("day"), "failed")
    made = told.groupBy("path").applyInPandasWithState(
        step, "path string, at long, failed boolean", "held string", "append", GroupStateTimeout.NoTimeout
    )
    return made.withColumn("at", F.timestamp_micros("at"))


def drain(stream: DataFrame, checkpoint: str, sink) -> None:
    """Run a stream over what is there, giving each micro-batch and its number to ``sink``."""
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def folder_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)


def deliver(batch: DataFrame, number: int, output, remember) -> None:
    """Commit a micro-batch's output, then its state: nothing is learned from what was not
    delivered, and both are keyed by the batch number, so a repeat changes nothing."""
    kept = batch.persist()
    try:
        output(kept, number)
        remember(kept.filter(F.col("delivered")) if "delivered" in kept.columns else kept, number)
    finally:
        kept.unpersist()
