"""Ingestion jobs as a stateful stream: stages, cancellation between them, timeouts.

Events (job_id, seq, at, kind) submit a job, take it a stage on, fail it or ask to cancel it.  A
cancellation that is asked for is looked at between stages: the stage under way ends, and then the
job is cancelled instead of going on.  A job that no event moves for ``patience`` of event time is
given up by its timer: cancelled if that was asked for, else failed.  Final states stay.

State is a value for each job and one timer; it lives in the RocksDB store that transformWithState
needs, in the query's checkpoint, so a run that starts again goes on with every job where it was.
A job's events of one trigger are taken by seq; repeated ones and those of a seq that was passed
already count for nothing; an event of a job that wasn't submitted submits it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarrystone.streaming.ingest import FINAL, NEXT

EVENTS = "job_id long, seq long, at timestamp, kind string"
OUT = "job_id long, state string, reason string, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(state: str, asked: bool, kind: str) -> tuple[str, bool, str]:
    """State, whether cancellation is asked for, and why, after one event."""
    if state in FINAL:
        return state, asked, ""
    if kind == "cancel":
        return state, True, "cancel asked"
    if kind == "fail":
        return "failed", asked, "stage failed"
    if kind == "advance":
        return ("cancelled", True, "cancelled") if asked else (NEXT[state], False, "stage ended")
    return state, asked, "submitted"


def needed(events: pd.DataFrame, last: int) -> pd.DataFrame:
    """Of a job's events those that can matter, by seq: the first few steps, the first of each
    other kind, and the last of all, which says when the job was moved."""
    new = events[events["seq"] > last].drop_duplicates("seq").sort_values("seq")
    nth = new.groupby("kind").cumcount()
    return new[(nth == 0) | ((new["kind"] == "advance") & (nth < len(NEXT))) | (new["seq"] == new["seq"].max())]


class Jobs(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, asked boolean, seq long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, asked, last, timer = self.job.get() if self.job.exists() else ("queued", False, -1, -1)
        events = None
        for frame in rows:
            events = needed(frame if events is None else pd.concat([events, frame]), last)
        reason, moved = "", None
        for seq, at, kind in zip(events["seq"], events["at"], events["kind"], strict=True):
            if seq > last and state not in FINAL:
                state, asked, reason = after(state, asked, kind)
                last, moved = int(seq), at
        if moved is None:
            return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = -1
        if state not in FINAL:
            timer = int(moved.timestamp() * 1000) + self.patience
            if timer <= timerValues.getCurrentWatermarkInMs():  # it was given up before its event came
                state, reason, timer = "cancelled" if asked else "failed", "given up", -1
            else:
                self.handle.registerTimer(timer)
        self.job.update((state, asked, last, timer))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "reason": [reason], "seq": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, asked, last, _ = self.job.get()
        if state in FINAL:
            return
        state = "cancelled" if asked else "failed"
        self.job.update((state, asked, last, -1))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "reason": ["given up"], "seq": [last]})

    def close(self) -> None:
        """Nothing is held besides the state."""


def transitions(events: DataFrame, *, patience: int = 3600, late: int = 600) -> DataFrame:
    """A stream of EVENTS to a row for each job that changed in a trigger; seconds of event time."""
    d = events.withWatermark("at", f"{late} seconds")
    return d.groupBy("job_id").transformWithStateInPandas(Jobs(patience * 1000), OUT, "Update", "EventTime")


def run(spark: SparkSession, events: DataFrame, root: str, *, patience: int = 3600, late: int = 600) -> None:
    """Takes what events there are; changes go under ``root``, by batch, and so does the state."""
    conf = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    try:
        transitions(events, patience=patience, late=late).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, state, reason, seq) of every job, as its latest change has it; the list of jobs."""
    d = spark.read.schema(f"{OUT}, batch long").parquet(f"{root}/changes")
    return d.groupBy("job_id").agg(F.max_by(F.struct("state", "reason", "seq"), "batch").alias("x")).select("job_id", "x.*")
