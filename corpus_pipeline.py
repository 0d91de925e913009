"""From raw documents to shards: a corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  Stages decide on rows, known by doc_id
and a hash of the text, so rows that share an id or have none don't share a fate.

Defined results: null and empty texts, as all of fewer than 50 words, fail the quality
rules; of rows that repeat an id and a text the near-duplicate stage keeps one, and of
rows of one id with other texts what it keeps depends on the texts alone; rows without
an id are compared with no other, and stay unless they fail the rules or hold a
benchmark item; of linked documents with equal smallest ids the one of smallest text
hash stays; texts of any length count whole; empty tables give empty results, and
without labels or benchmark the base check alone decides and nothing leaks; further
columns of documents, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from quarrystone.llm.common import ROW, dropped, read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or a learned rule go."""
    rules = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(f"{ROW}.*")


def _mark() -> Column:
    return F.xxhash64("text")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= jaccard_join.BROADCAST_ROWS else df


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents against the stored, distinct (doc_id, mark) of rows, broadcast while they are few."""
    new = "__"
    while any(c.startswith(new) for c in docs.columns):
        new += "_"
    rows = _few(rows.toDF(f"{new}id", f"{new}mark"))
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(f"{new}id")) & (_mark() == F.col(f"{new}mark")), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar sets of five-word shingles the smallest doc_id stays, once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("string").alias("text"))
    found = stored(jaccard_join.classes(slim), "classes")
    gone = found.where("doc_id <> component_id").select("doc_id", "mark")
    heads = found.where("doc_id = component_id and class is not null").groupBy("doc_id", "class").agg(F.min("mark").alias("least"), F.max("mark").alias("most"), F.count(F.lit(1)).alias("n"))
    heads = stored(heads.where("n > 1"), "heads")  # rows that share an id and a class
    if heads.take(1):
        others = heads.where("least < most").select("doc_id", "class", "least")
        gone = gone.unionByName(found.join(others, ["doc_id", "class"]).where("mark > least").select("doc_id", "mark"))
    gone = stored(gone.distinct(), "copies")
    dropped(found)
    if not heads.take(1):
        return _joined(docs, gone, "left_anti")
    again = stored(heads.select("doc_id", F.col("least").alias("mark")).distinct(), "repeated")
    once = _joined(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(docs, stored(gone.unionByName(again), "apart"), "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edits and all, go."""
    slim = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), _mark().alias("mark")).alias("key"), F.col("text").cast("string").alias("text"))
    hits = decontaminate.matches(slim, read_table(spark, sf_dir, "benchmark"), doc_id="key")
    return _joined(docs, stored(hits.select("doc_id.id", "doc_id.mark").distinct(), "leaks"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources come up to twice; every document stays at least once."""
    return mixing.mix(docs, mixing.Target(most_repeats=2.0)).select(f"{ROW}.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 8)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The stages learn rules and compare sets: no SQL states them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
