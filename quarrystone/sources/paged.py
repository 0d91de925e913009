"""A paged source of records: a Python data source, batch and stream, over saved pages of a service.

Live services can't be asked here; a crawl saves its pages, each a file with a JSON list of
records, in a folder that all machines share, by any path or URI that pyarrow opens.  Pages are
read in order of their names, a partition each.

As a stream, its offset is the number of pages read, so the crawl's cursor lies in the checkpoint:
a run that is lost within a page does that batch again and no other.  ``pages_per_batch`` bounds a
batch.  A page that can't be parsed doesn't stop the crawl; it gives one row that says why, which
``crawl`` keeps on a list of failed pages, to be tried again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarrystone.sources.shared import is_there

SUFFIXES = (".json", ".txt")


def _pages(path: str) -> tuple[fs.FileSystem, str, list[str]]:
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return store, root, sorted(f.path.removeprefix(root).lstrip("/") for f in found if f.is_file and f.path.endswith(SUFFIXES))


def _records(path: str, page: str) -> Iterator[tuple]:
    store, root = fs.FileSystem.from_uri(path)
    try:
        with store.open_input_stream(f"{root}/{page}") as f:
            rows = [(page, k, json.dumps(record), None) for k, record in enumerate(json.loads(f.read()))]
    except (ValueError, TypeError, OSError) as e:
        rows = [(page, None, None, f"{type(e).__name__}: {e}"[:500])]
    yield from rows


class SavedPages(DataSource):
    """Options: path; only (a JSON list of page names), for a batch; pages_per_batch and fresh
    (nothing was read before), for a stream."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "page string, position int, json string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("only"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("pages_per_batch", 100)), self.options.get("fresh") == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self) -> list[InputPartition]:
        names = json.loads(self.only) if self.only else _pages(self.path)[2]
        return [InputPartition(n) for n in names] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(()) if partition.value is None else _records(self.path, partition.value)


class _Stream(DataSourceStreamReader):
    """Pages only come at the end of the list: names rise, as page numbers do."""

    def __init__(self, path: str, most: int, fresh: bool):
        self.path, self.most, self.at = path, most, 0 if fresh else None

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        n = len(_pages(self.path)[2])
        # Never less than what was read: where the last run ended isn't known, all there is.
        return {"pages": n if self.at is None else min(n, self.at + self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["pages"]
        return [InputPartition(n) for n in _pages(self.path)[2][start["pages"] : end["pages"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _records(self.path, partition.value)

    def commit(self, end: dict) -> None:
        self.at = end["pages"]


def crawl(spark: SparkSession, path: str, out: str, checkpoint: str, taken: Callable[[DataFrame], DataFrame], pages_per_batch: int = 100) -> None:
    """Takes all pages that are there and not taken yet: ``taken`` makes rows of records (page,
    position, json), which go to ``out``/records, pages that failed to ``out``/failed, both under
    the batch's number, so that a batch that runs again replaces itself."""
    spark.dataSource.register(SavedPages)

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.where("error is not null").select("page", "error").write.mode("overwrite").parquet(f"{out}/failed/batch={number}")
            taken(batch.where("error is null").drop("error")).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        finally:
            batch.unpersist()

    while True:  # a run ends at the offset that was the latest when it began
        fresh = str(not is_there(spark, f"{checkpoint}/offsets/0")).lower()
        rows = spark.readStream.format("saved_pages").options(path=path, pages_per_batch=pages_per_batch, fresh=fresh).load()
        run = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        if not any(p["numInputRows"] for p in run.recentProgress):
            return


def failed(spark: SparkSession, out: str) -> DataFrame:
    """(page, error) of pages that failed and weren't read since."""
    f = spark.read.parquet(f"{out}/failed")
    last = f.groupBy("page").agg(F.max_by("error", "batch").alias("error"), F.max("batch").alias("batch"))
    return last.where("error is not null").select("page", "error")


def retried(spark: SparkSession, path: str, out: str, taken: Callable[[DataFrame], DataFrame]) -> int:
    """Reads failed pages again; returns how many are well now.  Their rows go under a negative
    batch number, and a row without an error takes them off the list; run it between crawls."""
    spark.dataSource.register(SavedPages)
    again = [r["page"] for r in failed(spark, out).collect()]
    if not again:
        return 0
    rows = spark.read.format("saved_pages").option("path", path).option("only", json.dumps(again)).load()
    number = spark.read.parquet(f"{out}/failed").agg(F.max(F.abs("batch"))).first()[0] + 1
    bad = rows.where("error is not null").select("page", "error")
    well = rows.where("error is null").select("page").distinct().withColumn("error", F.lit(None).cast("string"))
    taken(rows.where("error is null").drop("error")).write.mode("overwrite").parquet(f"{out}/records/batch=-{number}")
    bad.unionByName(well).write.mode("overwrite").parquet(f"{out}/failed/batch={10**9 + number}")
    return well.count()
