"""What the training-data operators share: words, tables and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "__input_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def id_crc32(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, a local master gets a
    temporary one (tests); a cluster has no folder that all machines see, so it's an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        there = sc._jsc.sc().getCheckpointDir()
        if there.isDefined():
            path = there.get()
        elif sc._jsc.sc().isLocal():
            path = tempfile.mkdtemp(prefix="quarrystone-")
            sc.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return path.rstrip("/")


#: Rows of texts that go to a Python worker at once, at most: a batch is held several times over.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Python workers get at most BATCH_ROWS rows at once; then what held before holds again."""
    was = spark.conf.get(_BATCH)
    if 0 < int(was) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost
    executors.  With ``texts``, Python workers get small batches meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark) if texts else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of frames made by ``stored`` that nothing needs any more."""
    for df in frames:
        if at := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
