"""Incremental work: ingestion of documents, windows over a query log, jobs' states."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone.operators.chunking import token_windows
from quarrystone.sources.shared import shared_dir

#: The way of a job; what may follow each state.
NEXT = {"queued": "downloading", "downloading": "chunking", "chunking": "embedding", "embedding": "done"}
FINAL = ("done", "failed", "cancelled")
ACTIVE = ("queued", "downloading", "chunking", "embedding")


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def ingest(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id", text: str = "text"):
    """Chunks each batch of documents and writes it under the batch's number: a batch that
    runs again replaces itself, so a restart doubles nothing.  Starts the query."""

    def one(batch: DataFrame, number: int) -> None:
        token_windows(batch.dropDuplicates([key]), key, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Chunks of each document as its latest batch has them."""
    d = spark.read.parquet(out)
    last = d.groupBy(key).agg(F.max("batch").alias("batch"))
    return d.join(last, [key, "batch"], "left_semi").drop("batch")


def windowed(events: DataFrame, at: str = "ts", value: str = "value", size: str = "1 hour", slide: str | None = None, late: str | None = "1 hour", *by: str) -> DataFrame:
    """Count, average and largest by window: tumbling, or sliding with ``slide``; the same
    for a table and for a stream, which drops what comes later than ``late``."""
    d = events.withWatermark(at, late) if late and events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    a = d.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 8).alias("avg_value"), F.round(F.max(value), 8).alias("max_value"))
    return a.select(F.col("w.start").alias("start"), *by, "n", "avg_value", "max_value")


def sessions(events: DataFrame, who: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.groupBy(F.session_window(at, gap).alias("w"), who).agg(F.count(F.lit(1)).alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def step(state: str, event: str) -> str:
    """The state after an event: ``advance``, ``fail`` or ``cancel``; final states stay."""
    if state in FINAL:
        return state
    return {"advance": NEXT.get(state, state), "fail": "failed", "cancel": "cancelled"}.get(event, state)


def job_states(events: DataFrame, job: str = "job_id", event: str = "event", order: str = "seq") -> DataFrame:
    """A stream's job events to each job's state so far.  A job's events of one trigger come in
    any order and in any number of frames.  Only the first that ends it and as many of the first
    steps forward as a job has can matter, so these are all that is kept of them."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        forward, ending = [], []
        for f in frames:
            on = f[event] == "advance"
            forward = sorted([*forward, *((x, "advance") for x in f.loc[on, order].nsmallest(len(NEXT)))])[: len(NEXT)]
            ends = f[f[event].isin(["fail", "cancel"])]
            ending = sorted([*ending, *zip(ends[order], ends[event], strict=True)])[:1]
        now = state.get[0] if state.exists else "queued"
        for _, e in sorted([*forward, *ending]):
            now = step(now, e)
        state.update((now,))
        yield pd.DataFrame({job: [key[0]], "state": [now]})

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def collected(query_of: Callable[[], DataFrame], mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote to the shared folder, a folder
    for each batch; with ``key``, only the latest row of each key."""
    d = query_of()
    spark = d.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], d.schema).write.parquet(f"{out}/batch=-1")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    d.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    if mode == "complete":  # each batch has all of it
        return found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch")
    if key is None:
        return found.drop("batch")
    rest = [c for c in d.columns if c != key]
    return found.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest]).select(d.columns)
