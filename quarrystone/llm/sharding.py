"""Sharding by sampled splitters, shards of nearly equal bytes.

The key is (xxhash64 of the text, doc_id, row): equal texts lie side by side, and a group
larger than a range is still divided, even where rows repeat.  A sample drawn in
proportion to size, with ROW_COST for each record so that tiny ones count, gives quantile
boundaries of ranges, many more than shards and more as the data grow; ranges that turn
out overfull get splitters from denser samples of their own until none is.  Workers find
a record's range by binary search.  Running sums within the ranges, set on the ranges'
totals, give each record its place in the whole order, and cut that order into shards of
equal bytes to within one record.

The law is ``bytes``: where a shard's bound falls within a group of equal texts, the
group is cut there; no other group is.

Defined results: a null text has size 1 and crc32 0; texts of any length count whole;
rows with equal ids and texts keep separate slots, in the order in which they were read;
a null id sorts before all others; with no rows there are no shards; only the named
columns of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import dropped, stored

#: (key, id, row): a record belongs to the first range whose splitter is not below it.
Splitter = tuple[int, int, int]
#: An id that is null sorts before all others.
NO_ID = -(2**63)
#: What a record counts besides its bytes when ranges are cut, and a range's most of both, about.
ROW_COST, RANGE_BYTES = 256, 2 << 30
#: Rounds in which overfull ranges are subdivided; each draws twice as densely.
MOST_ROUNDS = 30


def _records(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"), F.monotonically_increasing_id().alias("row"))


def places(key: np.ndarray, at: np.ndarray, row: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters, sorted rows of (key, id, row), are below each record."""
    out = np.searchsorted(splitters[:, 0], key, "left")
    for k in np.unique(key[out != np.searchsorted(splitters[:, 0], key, "right")]):
        on, of = np.flatnonzero(key == k), splitters[splitters[:, 0] == k]
        n = len(on)
        order = np.lexsort((np.arange(n + len(of)) >= n, np.concatenate([row[on], of[:, 2]]), np.concatenate([at[on], of[:, 1]])))
        below = np.cumsum(order >= n)
        mine = order < n
        out[on[order[mine]]] += below[mine]
    return out


def ranged(records: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """The records with their range."""
    shared = records.sparkSession.sparkContext.broadcast(np.array(splitters, np.int64).reshape(-1, 3))
    kinds = ", ".join(f"{n} {t}" for n, t in records.dtypes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = (batch.column(c).to_numpy() for c in ("key", "row"))
            at = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(key, at, row, shared.value), pa.int32())], [*batch.schema.names, "range"])

    return records.mapInArrow(found, f"{kinds}, range int")


def sample(records: DataFrame, step: float, seed: int) -> list[tuple[int, int, int, float]]:
    """(key, id, row, weight) of records drawn with a chance of their weight over ``step``:
    about total over ``step`` of them.  Drawn by hash, so a task run again draws the same."""
    weight = F.col("size") + ROW_COST
    u = F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id", "row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = records.where(u < weight / F.lit(step))
    return sorted(tuple(r) for r in drawn.select("key", F.coalesce("doc_id", F.lit(NO_ID)), "row", F.greatest(weight.cast("double"), F.lit(step))).collect())


def quantiles(drawn: list[tuple[int, int, int, float]], parts: int) -> list[Splitter]:
    total, run, out = sum(x[3] for x in drawn), 0.0, []
    for *at, w in drawn:
        run += w
        if len(out) < parts - 1 and run >= total * (len(out) + 1) / parts:
            out.append(tuple(at))
    return out


def splitters_of(records: DataFrame, least: int, *, most_bytes: int = RANGE_BYTES, draws: int = 20, overfull: float = 2.0, seed: int = 5) -> tuple[list[Splitter], list[tuple[int, int, int]]]:
    """Splitters, and (range, rows, bytes) of each range that has rows: ``least`` ranges, or
    as many as hold ``most_bytes`` each."""
    n, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = size + ROW_COST * n
    ranges = max(least, -(-total // most_bytes))
    goal = max(total / ranges, 1.0)
    split = quantiles(sample(records, goal / draws, seed), ranges) if total else []
    for k in range(MOST_ROUNDS):
        placed = ranged(records.select("doc_id", "size", "key", "row"), split)
        found = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("size").alias("largest")).collect()
        # overfull even without its largest record, which can't be shared
        full = {r["range"]: r["size"] + ROW_COST * r["n"] for r in found if r["size"] - r["largest"] + ROW_COST * (r["n"] - 1) > overfull * goal}
        if not full:
            return split, sorted(tuple(r)[:3] for r in found)
        more = sample(placed.where(F.col("range").isin(list(full))), goal / (draws * 2 ** (k + 1)), seed + 1 + k)
        inside: dict[int, list] = {r: [] for r in full}
        if more:
            three = np.array([x[:3] for x in more], np.int64)
            for x, r in zip(more, places(*three.T, np.array(split, np.int64).reshape(-1, 3)).tolist(), strict=True):
                inside[r].append(x)
        split = sorted({*split, *(s for r, xs in inside.items() for s in quantiles(xs, 1 + int(full[r] / goal)))})
    raise RuntimeError(f"ranges are still overfull after {MOST_ROUNDS} rounds")


def shard(docs: DataFrame, shards: int = 8, *, doc_id: str = "doc_id", text: str = "text", ranges_per_shard: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record."""
    records = stored(_records(docs, doc_id, text), "records")
    spark = docs.sparkSession
    split, found = splitters_of(records, shards * ranges_per_shard)
    rows = bytes_ = 0
    before = []
    for r, n, size in found:
        before.append((r, rows, bytes_))
        rows, bytes_ = rows + n, bytes_ + size
    starts = spark.createDataFrame(before, "range int, rows_before long, bytes_before long")
    w = Window.partitionBy("range").orderBy("key", "doc_id", "row")
    d = ranged(records, split)
    d = d.withColumns({"nth": F.row_number().over(w), "run": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.join(F.broadcast(starts), "range")  # a row for each range: in proportion to the bytes over RANGE_BYTES
    middle = F.col("bytes_before") + F.col("run") - F.col("size") / 2
    at = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(bytes_, 1))))).cast("int")
    d = stored(d.select("doc_id", "size", "text_crc32", at.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place")), "placed")
    dropped(records)
    first = d.groupBy("shard").agg(F.min("place").alias("first"))
    d = d.join(F.broadcast(first), "shard")
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
