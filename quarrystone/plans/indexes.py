"""Queries over indexes that prune, approximate and grow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrystone.operators import ann, lexical, pruned, segments
from quarrystone.plans.base import ORACLES, query, table
from quarrystone.plans.retrieval import asked, index_of, questions, vectors
from quarrystone.sources.shared import shared_dir


def blocks_of(spark, sf_dir):
    """The index of documents and its blocks."""
    index = index_of(spark, sf_dir)
    return pruned.of_snapshot(index, table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet"), index


@query("bm25_pruned", ORACLES["bm25_topk"])
def bm25_pruned(spark, sf_dir):
    """The same rows as an exhaustive top k, from a part of the postings."""
    return pruned.top(*blocks_of(spark, sf_dir), questions(spark, sf_dir), 10).select("qid", "doc_id", "score", "rank")


def grown(spark, sf_dir) -> str:
    """An index of an older corpus, in which a twentieth of the texts was another, a tenth was
    missing and others were there, brought up to date by one segment."""
    root = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    stale = d.where("doc_id % 10 <> 1").select("doc_id", F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("stale "), "source")).otherwise(F.col("text")).alias("text"))
    extra = d.where("doc_id % 25 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    segments.add(spark, root, stale.unionByName(extra))
    segments.add(spark, root, d.where("doc_id % 20 = 0 or doc_id % 10 = 1").select("doc_id", "text"), extra.select("doc_id"))
    return root


@query("bm25_incremental", ORACLES["bm25_topk"])
def bm25_incremental(spark, sf_dir):
    return lexical.top(segments.load(spark, grown(spark, sf_dir)), questions(spark, sf_dir), 10).select("qid", "doc_id", "score", "rank")


@query("incremental_stats", ORACLES["bm25_stats"])
def incremental_stats(spark, sf_dir):
    """Statistics that segments add up to, those of a full rebuild."""
    return segments.load(spark, grown(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def near(spark, sf_dir, keep=None):
    v = vectors(spark, sf_dir)
    model = ann.fit(v)
    index = ann.indexed(v, model, f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", attributes=("label",))
    return ann.top(index, v, asked(spark, sf_dir), 20, model, keep=keep)


@query("ann_topk")
def ann_topk(spark, sf_dir):
    """Probed lists of int8 codes, ranked exactly; the tests hold recall against ``dense_topk``."""
    return near(spark, sf_dir)


@query("ann_topk_filtered")
def ann_filtered(spark, sf_dir):
    return near(spark, sf_dir, F.col("label") % 3 == 0)
