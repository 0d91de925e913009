"""A lexical index that grows: segments of changed papers, tombstones, statistics that add up.

A segment holds the postings and lengths of the papers that came with it, tombstones of the papers
that it replaces or deletes, and what it changes in the statistics: for each term the papers more
or less, and the numbers of papers and words more or less.  Only texts of new and changed papers
are tokenized; of those that go, older postings are read.  The statistics of the index are sums
over segments.  A version of the index is a list of segments; it becomes the current one by one
rename of the manifest, and only if as many papers are alive as the statistics say.

A paper is alive in the newest segment that holds it, unless a later one has a tombstone for it.
Repeated ids among the changed papers are an error, as neither would be the newest; null texts have
no words; deleting what isn't there changes nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import lexical_tokens
from quarrystone.operators.lexical import Index, by_document, weighted_terms
from quarrystone.sources.files import manifest, write_text
from quarrystone.sources.shared import dropped, is_there, stored

PARTS = ("postings", "docs", "gone", "terms", "sums")


def current(spark: SparkSession, root: str) -> list[str]:
    """The segments of the current version, oldest first."""
    return manifest(spark, root)["segments"] if is_there(spark, f"{root}/manifest.json") else []


def _read(spark: SparkSession, root: str, segments: list[str], part: str) -> DataFrame:
    """A part of all segments, with each segment's number as ``seq``."""
    out = None
    for k, name in enumerate(segments):
        d = spark.read.parquet(f"{root}/{name}/{part}").withColumn("seq", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


def _alive(d: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, seq) that no later segment has a tombstone for; tombstones are one a paper."""
    last = gone.groupBy("doc_id").agg(F.max("seq").alias("__gone"))
    return d.join(last, "doc_id", "left").where(F.col("__gone").isNull() | (F.col("seq") >= F.col("__gone"))).drop("__gone")


def load(spark: SparkSession, root: str, segments: list[str] | None = None) -> Index:
    """The index of a version; raises if its statistics have other numbers than its papers."""
    segments = current(spark, root) if segments is None else segments
    if not segments:
        raise ValueError(f"there is no index in {root}")
    gone = _read(spark, root, segments, "gone")
    postings, docs = (_alive(_read(spark, root, segments, part), gone).drop("seq") for part in ("postings", "docs"))
    sums = _read(spark, root, segments, "sums").agg(F.sum("n").alias("n"), F.try_divide(F.sum("words"), F.sum("n")).alias("avgdl"))
    counts = _read(spark, root, segments, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    index = Index(postings, docs, weighted_terms(counts, sums), sums, by_document(postings, docs))
    if not index.consistent():
        raise ValueError("the index has other documents than its statistics")
    return index


def add(spark: SparkSession, root: str, changed: DataFrame, deleted: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes a segment of new, changed and deleted papers and makes it part of the current version."""
    segments, name = current(spark, root), f"segment-{uuid.uuid4().hex}"
    at = f"{root}/{name}"
    tokens = stored(changed.select(F.col(doc_id).alias("doc_id"), lexical_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), "tokens")
    if tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError("a paper comes twice in one segment")

    def kept(d: DataFrame, part: str) -> DataFrame:
        d.write.parquet(f"{at}/{part}")
        return spark.read.schema(d.schema).parquet(f"{at}/{part}")

    docs = kept(tokens.select("doc_id", F.size("tokens").cast("long").alias("len")), "docs")
    postings = kept(tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    dropped(tokens)
    ids = docs.select("doc_id")
    ids = ids.unionByName(deleted.select(F.col(doc_id).alias("doc_id"))).distinct() if deleted is not None else ids
    gone = kept(ids, "gone")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    if segments:
        before = _read(spark, root, segments, "gone")
        was = {part: _alive(_read(spark, root, segments, part).join(gone, "doc_id", "left_semi"), before) for part in ("postings", "docs")}
        terms = terms.unionByName(was["postings"].groupBy("term").agg((-F.count(F.lit(1))).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        sums = sums.unionByName(was["docs"].agg((-F.count(F.lit(1))).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("words"))).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    kept(terms, "terms")
    kept(sums, "sums")
    load(spark, root, [*segments, name])  # raises before anything is seen
    if current(spark, root) != segments:
        raise RuntimeError("another writer has changed the index meanwhile")
    write_text(spark, f"{root}/manifest.json", json.dumps({"segments": [*segments, name]}))
    return name


def compact(spark: SparkSession, root: str) -> str:
    """Rewrites the papers alive as one segment, without tokenizing anything."""
    segments, name = current(spark, root), f"segment-{uuid.uuid4().hex}"
    index = load(spark, root, segments)
    for part, d in {
        "postings": index.postings, "docs": index.docs, "gone": index.docs.select("doc_id").limit(0),
        "terms": _read(spark, root, segments, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"),
        "sums": _read(spark, root, segments, "sums").agg(F.sum("n").alias("n"), F.sum("words").alias("words")),
    }.items():
        d.write.parquet(f"{root}/{name}/{part}")
    load(spark, root, [name])
    if current(spark, root) != segments:
        raise RuntimeError("another writer has changed the index meanwhile")
    write_text(spark, f"{root}/manifest.json", json.dumps({"segments": [name]}))
    return name
