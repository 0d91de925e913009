"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast; they are counted first.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Where that is unset, a local master gets a temporary
    folder (tests); a cluster has none that all its machines see, so it's an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext._jsc.sc()
    if not path and sc.getCheckpointDir().isDefined():
        path = sc.getCheckpointDir().get()
    if not path:
        if not sc.isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def version_of(spark: SparkSession, path: str) -> str:
    """Stands for what is at a path: its length, its number of files and when it was changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    return hashlib.sha1(f"{path}|{held.getLength()}|{held.getFileCount()}|{fs.getFileStatus(at).getModificationTime()}".encode()).hexdigest()[:20]


def is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder to a name that isn't taken; if it is, what was to be moved goes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(old), hadoop.Path(new)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(b) and fs.rename(a, b):
        return True
    fs.delete(a, True)
    return False


def stored(d: DataFrame, name: str) -> DataFrame:
    """Written and read again: what follows doesn't compute it anew, nor when executors are lost."""
    path = f"{shared_dir(d.sparkSession)}/{name}-{uuid.uuid4().hex}"
    d.write.parquet(path)
    out = d.sparkSession.read.schema(d.schema).parquet(path)
    out._stored_at = path
    return out


def few(d: DataFrame, name: str) -> DataFrame:
    """Written and counted, and broadcast where they are few: a large table joined with a handful of
    rows isn't shuffled for them, which Spark can't know beforehand."""
    d = stored(d, name)
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def kept(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives for the table at ``source``, written once for each version of it; a table
    that is half written stands beside and is never read."""
    root = f"{shared_dir(spark)}/{name}-{version_of(spark, source)}"
    if not is_there(spark, f"{root}/_SUCCESS"):
        by = f"{root}.{uuid.uuid4().hex}"
        make().write.parquet(by)
        renamed(spark, by, root)  # of two sessions that write at once, the first stays
    return spark.read.parquet(root)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of frames made by ``stored`` that nothing reads any more."""
    for d in frames:
        if at := getattr(d, "_stored_at", None):
            path = d.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(d.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
