"""Repeats of a click within a time are one window: a stateful stream with event-time timeouts.

Rows (key, hour, digest) come in batches.  The first row of a key opens a window, rows of
up to ``span`` hours later repeat it, a later one closes it and opens the next.  The
watermark, ``late`` hours behind the largest hour of all earlier batches and kept in the
checkpoint, drops what comes later than that and times windows out.  Each start of the query
takes one batch in one micro-batch, as each of these costs a task for every partition of the
state, however few its rows: what is past its deadline after a batch is closed, as of that batch,
when the next one is taken.  At last a sentinel row far in the future lets all that is left time
out, in a micro-batch without data.

A call of a Python worker for a group costs some hundred times as much as the fold of a row.
So keys share groups by hash: a group's state is a tuple of columns, packed as bytes, with an
entry of 64 bytes for each open window; windows, folds and results stay those of each key.
``buckets`` follows the number of rows, so that a group's state and rows stay few.

Before the shuffle, equal rows (key, hour, digest) of a task's batch are added up.  Rows of a
group come in any order and any number of chunks; they are added up again chunk by chunk,
sorted by hour and digest, and folded.  So a key with very many equal rows takes no memory;
one with many different ones takes 56 bytes for each of a batch.

Defined results: rows without a key or an hour open nothing; repeated rows are repeats;
ties of an hour go by digest; a digest is any 32 bytes; an empty batch is passed over,
without rows there are no windows; columns of the input but the named ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "key long, hour long, digest binary"
WINDOWS = "key long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, digest binary"
STATE = "keys binary, starts binary, repeats binary, conflicts binary, sums binary, digests binary"
HOUR_MS = 3_600_000
#: Rows of a group's chunks that are held before they are added up again.
COMPACT = 1_000_000
#: Hours from the last row to the sentinel.
FAR = 1_000_000


def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal rows of each Arrow batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["bucket", "key", "hour", "digest"]).aggregate([("n", "sum")])
        yield from t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(b.schema.names).cast(b.schema).to_batches()


class Chunks:
    """The rows of one group: equal ones are added up whenever many have come."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, f: pd.DataFrame, least: int | None = None) -> None:
        """Takes rows of the hour ``least`` and later ones."""
        f = f[f["key"].notna() & f["hour"].notna() & f["digest"].notna()]
        f = f if least is None else f[f["hour"] >= least]
        if len(f):
            words = np.frombuffer(b"".join(f["digest"]), ">u8").reshape(-1, 4).astype(np.uint64)
            self.parts.append((f["key"].to_numpy(np.int64), f["hour"].to_numpy(np.int64), words, f["n"].to_numpy(np.int64)))
            self.held += len(f)
        if self.held > COMPACT:
            self.parts = [self.sorted()]
            self.held = 0

    def sorted(self) -> tuple[np.ndarray, ...]:
        """Distinct rows by key, hour and digest, with how many there are of each."""
        key, hour, words, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0], hour, key))
        key, hour, words, n = key[order], hour[order], words[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (hour[1:] != hour[:-1]) | (words[1:] != words[:-1]).any(1)
        at = np.flatnonzero(new)
        return key[at], hour[at], words[at], np.add.reduceat(n, at)


def fold(windows: dict[int, list], rows: tuple[np.ndarray, ...], span: int, number: int, closed: list[tuple]) -> None:
    """Takes sorted rows into the open windows (key to start, repeats, conflicts, sum, digest)."""
    keys, hours, words, counts = rows
    raw = words.astype(">u8").tobytes()
    for i, (key, hour, n) in enumerate(zip(keys.tolist(), hours.tolist(), counts.tolist(), strict=True)):
        digest = raw[32 * i : 32 * i + 32]
        w = windows.get(key)
        if w is not None and hour <= w[0] + span:
            w[1] += n
            if digest != w[4]:
                w[2] += n
                w[3] += n * zlib.crc32(digest.hex().encode())
            continue
        if w is not None:
            closed.append((key, w[0], number, *w[1:]))
        windows[key] = [hour, n - 1, 0, 0, digest]


def packed(windows: dict[int, list]) -> tuple:
    numbers = np.array([(k, *w[:4]) for k, w in windows.items()], np.int64).T
    return (*(x.tobytes() for x in numbers), b"".join(w[4] for w in windows.values()))


def unpacked(state: tuple) -> dict[int, list]:
    numbers = [np.frombuffer(x, np.int64).tolist() for x in state[:5]]
    return {k: [a, b, c, s, bytes(state[5][32 * i : 32 * i + 32])] for i, (k, a, b, c, s) in enumerate(zip(*numbers, strict=True))}


def stepped(number: int, before: int, span: int, origin: int, end: int | None) -> Callable:
    """The fold of a group in batch ``number``; ``before`` is the batch before it.  A watermark beyond
    ``end``, the last row's hour, is the sentinel's.  Rows below the watermark are left out here, as
    Spark drops those of a batch that follows another by the watermark before."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows, closed = unpacked(state.get) if state.exists else {}, []
        due = lambda start: (start + span - origin) * HOUR_MS
        limit = state.getCurrentWatermarkMs()
        as_of = number if end is not None and limit > (end - origin) * HOUR_MS else before
        for k in [k for k, w in windows.items() if due(w[0]) < limit]:
            w = windows.pop(k)
            closed.append((k, w[0], as_of, *w[1:]))
        if not state.hasTimedOut:
            chunks = Chunks()
            for f in frames:
                chunks.add(f, limit // HOUR_MS + origin + 1)
            if chunks.parts:
                fold(windows, chunks.sorted(), span, number, closed)
        if windows:
            state.update(packed(windows))
            state.setTimeoutTimestamp(max(limit, due(min(w[0] for w in windows.values()))))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=["key", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "digest"])

    return step


def windowed(rows: DataFrame, number: int, before: int, *, span: int = 72, late: int = 48, buckets: int = 64, origin: int = 0, end: int | None = None) -> DataFrame:
    """The stream of closed windows of a stream of rows, as batch ``number``; windows past their
    deadline close as of ``before``, but as of ``number`` once the watermark is beyond ``end``.

    Hours count from ``origin``, which no row is before, as Spark's first watermark is zero."""
    bucket = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(buckets)), F.lit(-1)).cast("int")
    d = rows.select(bucket.alias("bucket"), "key", "hour", "digest", F.lit(1).cast("long").alias("n")).mapInArrow(combined, "bucket int, key long, hour long, digest binary, n long")
    # Spark drops what is at the watermark too: a millisecond less keeps hours that are just late enough.
    d = d.withColumn("at", F.timestamp_seconds((F.col("hour") - origin + 1) * 3600)).withWatermark("at", f"{late * HOUR_MS + 1} milliseconds")
    return d.groupBy("bucket").applyInPandasWithState(stepped(number, before, span, origin - 1, end), WINDOWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(spark: SparkSession, batches: list[tuple[int, str]], root: str, *, last_hour: int, last_batch: int, span: int = 72, late: int = 48, buckets: int = 64, origin: int = 0) -> DataFrame:
    """The windows of all batches, (number, folder of Parquet files of ROWS) in order; what is
    open at last closes as of ``last_batch``.

    The query is started anew for each batch, all on one checkpoint under ``root``, a new
    folder; its results go to a file sink there, which counts every micro-batch once.  Lost
    executors cost their tasks alone; state comes back from the checkpoint."""
    if not batches:
        return spark.createDataFrame([], WINDOWS)
    conf, was = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.createDataFrame([(None, last_hour + span + late + FAR, None)], ROWS).write.parquet(f"{root}/sentinel")
    try:
        before = batches[0][0]
        for number, folder in [*batches, (last_batch, f"{root}/sentinel")]:
            spark.conf.set(conf, str(folder == f"{root}/sentinel").lower())
            # A pattern, so that the source may find the last batch again, which lies in another folder.
            rows = spark.readStream.schema(ROWS).parquet(f"{folder}/*.parquet")
            d = windowed(rows, number, before, span=span, late=late, buckets=buckets, origin=origin, end=last_hour)
            d.writeStream.format("parquet").option("path", f"{root}/windows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            before = number
    finally:
        spark.conf.set(conf, was)
    return spark.read.schema(WINDOWS).parquet(f"{root}/windows")
