"""Offline rebuild: papers to chunks, index and vectors, published as one snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import contextual_text, lexical_document, normalize_section, paper_text, source_text
from quarrystone.operators import chunking, lexical, tables
from quarrystone.plans.retrieve import Corpus, encoded
from quarrystone.sources import files


def chunks_of(papers: DataFrame, mode: str = "auto") -> DataFrame:
    """The chunks table of papers (paper_id, title, abstract, authors, categories, published, layer, full_text)."""
    p = papers.withColumn("__source", source_text(F.col("title"), F.col("abstract"), F.col("full_text"), mode))
    c = chunking.chunked(p, "paper_id", "__source").join(papers.drop("full_text", "abstract"), "paper_id")
    c = c.withColumn("section", normalize_section(F.col("section_heading")))
    c = c.withColumn("chunk_id", F.concat(F.col("paper_id").cast("string"), F.lit("_text_"), F.col("chunk_index").cast("string")))
    body = contextual_text(F.col("title"), F.col("authors"), F.col("categories"), F.col("section"), F.col("chunk_text"), F.col("chunk_index"), F.col("total_chunks"))
    c = c.withColumn("contextual_text", body)
    keep, warnings = chunking.valid(F.col("token_count"), F.col("chunk_text"), F.col("contextual_text"))
    c = c.withColumn("warnings", warnings).where(keep)
    return c.withColumn("lexical_text", lexical_document(F.col("title"), F.col("authors"), F.col("categories"), F.col("section"), F.col("chunk_text")))


def parents_of(papers: DataFrame, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame] = encoded) -> DataFrame:
    """(paper_id, vector): papers by title and abstract; without one, the chunks of that section stand for it."""
    pieces = chunks.where("section = 'abstract'").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("__pieces"))
    p = papers.select("paper_id", "title", "abstract").join(pieces, "paper_id", "left")
    written = F.trim(F.coalesce("abstract", F.lit("")))
    body = F.when(written != "", F.col("abstract")).otherwise(F.array_join(F.transform("__pieces", lambda s: s["chunk_text"]), " "))
    d = p.select("paper_id", paper_text(F.col("title"), body).alias("text")).where("text <> ''")
    return encode(d).select("paper_id", "vector")


def rebuild(papers: DataFrame, root: str, encode: Callable[[DataFrame], DataFrame] = encoded, mode: str = "auto") -> str:
    """Writes chunks first, then what is made of them, and publishes all at once."""
    spark = papers.sparkSession
    work = f"{root}/work-chunks"
    chunks_of(papers, mode).withColumn("doc_id", F.xxhash64("chunk_id")).write.mode("overwrite").parquet(work)
    c = spark.read.parquet(work)
    index = lexical.build(c, "doc_id", "lexical_text")
    vectors = encode(c.select("doc_id", F.col("contextual_text").alias("text"))).select("doc_id", F.col("vector").alias("embedding"))
    made = {"chunks": c, "vectors": vectors, "parents": parents_of(papers, c, encode), "postings": index.postings, "docs": index.docs, "terms": index.terms, "stats": index.stats}
    return files.publish(made, root, retrieval="bm25+dense")


def opened(spark: SparkSession, root: str, edges: DataFrame | None = None) -> Corpus:
    """The published snapshot; all its tables are of one version."""
    of = lambda name: files.snapshot(spark, root, name)
    index = lexical.Index(of("postings"), of("docs"), of("terms"), of("stats"), lexical.by_document(of("postings"), of("docs")))
    return Corpus(of("chunks").withColumnRenamed("chunk_text", "text"), of("vectors"), index, edges, of("parents"))


def extended(old: DataFrame, new: DataFrame, root: str, **options) -> str:
    """Live addition: papers of the same id are replaced, and everything is published anew."""
    return rebuild(tables.replaced(old, new, "paper_id"), root, **options)
