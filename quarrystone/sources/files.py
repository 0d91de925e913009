"""Readers and writers: JSON lines, JSON maps, documents, snapshots with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.text import normalize_published

SCHEMA_VERSION = 2
CHUNKS = "chunk_id string, paper_id string, chunk_type string, modality string, chunk_text string, contextual_text string, title string, authors string, categories string, section_hint string, page_start int, page_end int, token_count int, chunk_index int, total_chunks int, chunk_source string, layer string, published string, paper_abstract string"
PAPERS = "paper_id string, title string, abstract string, authors string, categories string, pdf_url string, published timestamp, updated timestamp, full_text string, download_status string, parse_status string, local_pdf_path string, quality_score float, is_seed boolean, layer string, source string, semantic_scholar_id string, created_at timestamp"
EDGES = "source string, target string, direction string, created_at timestamp"
QUERY_LOG = "timestamp string, query string, latency_ms double, stages_ms map<string,double>, intent string, num_sources int, cached boolean"
QUESTIONS = "query string, intent string, relevant_chunk_ids array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines count for nothing."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.json()).alias("x")).select("x.*")


def count_jsonl(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_papers_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of papers by id; values that aren't objects are left out."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("paper_id", "json"))
    each = each.where(F.trim("json").startswith("{"))
    d = each.select("paper_id", F.from_json("json", "title string, authors string, categories string, published string, layer string").alias("x")).select("paper_id", "x.*")
    return d.withColumn("published", normalize_published(F.col("published")))


def read_documents(spark: SparkSession, path: str, least_bytes: int = 1024, suffix: str = "pdf") -> DataFrame:
    """(paper_id, content) of files by name; smaller ones count as broken downloads."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1)
    return d.where(F.col("length") > least_bytes).select(name.alias("paper_id"), "length", "content")


def write_jsonl(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def append_log(d: DataFrame, path: str) -> None:
    d.write.mode("append").json(path)


def write_by_year(d: DataFrame, path: str, year: str = "year") -> None:
    d.write.mode("overwrite").partitionBy(year).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over the old one in one step, so that a reader sees the old or the new."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    by = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = by.getFileSystem(conf)
    out = fs.create(by, True)
    out.write(bytearray(text.encode()))
    out.close()
    by, to = fs.makeQualified(by), fs.makeQualified(hadoop.Path(path))
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), conf).rename(by, to, options)


def publish(tables: dict[str, DataFrame], root: str, **extra) -> str:
    """Writes all tables of a snapshot, then points the manifest at it: readers never see
    half of one, nor tables of different ones."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex[:12]
    rows = {}
    for name, d in tables.items():
        d.write.parquet(f"{root}/{version}/{name}")
        rows[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
    write_text(spark, f"{root}/manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, "corpus_version": version, "rows": rows} | extra, sort_keys=True))
    return version


def manifest(spark: SparkSession, root: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))


def snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published snapshot; its rows must be as many as the manifest says."""
    m = manifest(spark, root)
    d = spark.read.parquet(f"{root}/{m['corpus_version']}/{name}")
    if d.count() != m["rows"][name]:
        raise ValueError(f"{name} has other rows than its manifest says")
    return d


def digest(d: DataFrame) -> DataFrame:
    """sha256 of each file's content beside its name."""
    return d.select("paper_id", F.sha2("content", 256).alias("sha256"))


def from_citation_records(d: DataFrame, column: str = "json") -> DataFrame:
    """Papers from records of a citation service."""
    schema = "paperId string, externalIds map<string,string>, title string, abstract string, year int, authors array<struct<name:string>>"
    x = d.select(F.from_json(column, schema).alias("x")).select("x.*")
    return x.select(F.coalesce(F.col("externalIds")["ArXiv"], F.lit("")).alias("paper_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("authors"), F.when(F.col("year").isNotNull(), F.concat(F.col("year").cast("string"), F.lit("-01-01"))).alias("published"), F.col("paperId").alias("semantic_scholar_id")).where("paper_id <> ''")


def from_atom_entries(d: DataFrame, column: str = "xml") -> DataFrame:
    """Papers from Atom entries, one a row."""
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(column, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    every = lambda pattern: F.array_join(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), ", ")
    return d.select(F.regexp_extract(one("id"), r"(\d{4}\.\d{4,5})", 1).alias("paper_id"), one("title").alias("title"), one("summary").alias("abstract"), every(r"(?s)<author>\s*<name>(.*?)</name>").alias("authors"), every(r'<category[^>]*term="([^"]+)"').alias("categories"), normalize_published(one("published")).alias("published"))
