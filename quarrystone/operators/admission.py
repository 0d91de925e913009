"""What comes into the corpus: admission, seeds, citation expansion, texts, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import is_paper_id, is_relevant, layer_of
from quarrystone.operators import tables

ACTIVE = ("queued", "downloading", "chunking", "embedding")


def admitted(found: DataFrame, papers: DataFrame, least_abstract: int = 200, digits: str = "4,5") -> DataFrame:
    """New papers of proper id (``digits`` after the point) that are relevant and have an abstract."""
    d = found.where(is_paper_id(F.col("paper_id"), digits) & is_relevant(F.col("title"), F.col("abstract")) & (F.length(F.coalesce("abstract", F.lit(""))) >= least_abstract))
    return d.dropDuplicates(["paper_id"]).join(papers.select("paper_id"), "paper_id", "left_anti")


def within_corpus_cap(new: DataFrame, have: int, most: int, order: str = "paper_id") -> DataFrame:
    """The first new papers that the cap leaves room for."""
    return new.orderBy(order).limit(max(0, most - have))


def seeded(papers: DataFrame, seeds: DataFrame, records: DataFrame) -> DataFrame:
    """Seeds that are there are marked, of their layer; others come from a service's records,
    or as the minimum that the seed list says."""
    s = seeds.select("paper_id", F.col("title").alias("s_title"), F.col("layer").alias("s_layer"))
    marked = papers.join(s, "paper_id", "left")
    on = F.col("s_layer").isNotNull()
    marked = marked.withColumns({"layer": F.coalesce("s_layer", "layer"), "is_seed": on | F.coalesce("is_seed", F.lit(False))}).select(papers.columns)
    new = s.join(papers.select("paper_id"), "paper_id", "left_anti").join(records.select("paper_id", F.col("title").alias("r_title"), "abstract"), "paper_id", "left")
    new = new.select("paper_id", F.coalesce("r_title", "s_title").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.col("s_layer").alias("layer"), F.lit(True).alias("is_seed"))
    return marked.unionByName(new, allowMissingColumns=True)


def expanded(papers: DataFrame, edges: DataFrame, links: DataFrame, direction: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers and edges with what seeds refer to or are cited by: links (seed, paper_id,
    title, abstract, year).  Last, how many each reason kept out."""
    title = F.trim(F.coalesce("title", F.lit("")))
    relevant = is_relevant(F.col("title"), F.col("abstract"))
    reasons = links.agg(F.count_if(title == "").alias("no_title"), F.count_if((title != "") & ~relevant).alias("not_relevant"), F.count_if((title != "") & relevant).alias("accepted"))
    ok = links.where((title != "") & relevant & (F.coalesce("paper_id", F.lit("")) != ""))
    new = ok.withColumn("layer", layer_of(F.col("year"), F.lit(direction == "reference"))).groupBy("paper_id").agg(F.first("title").alias("title"), F.first("abstract").alias("abstract"), F.min("layer").alias("layer"))
    merged = tables.upsert(papers.select("paper_id", "title", "abstract", "layer"), new, "paper_id", tables.PAPER_RULES)
    found = ok.select(F.col("seed").alias("source"), F.col("paper_id").alias("target"), F.lit(direction).alias("direction"))
    return merged, tables.insert_ignore(edges, found, ["source", "target", "direction"]), reasons


def enriched(papers: DataFrame, texts: DataFrame, least: int = 100) -> DataFrame:
    """Papers with the texts that downloads gave, and their statuses: a text that is too
    short counts as not parsed, a missing download as failed."""
    d = papers.join(texts.select("paper_id", F.col("text").alias("__t"), F.lit(True).alias("__on")), "paper_id", "left")
    got, good = F.coalesce("__on", F.lit(False)), F.length(F.trim(F.coalesce("__t", F.lit("")))) > least
    return d.withColumns({
        "full_text": F.when(got & good, F.col("__t")).otherwise(F.col("full_text")),
        "download_status": F.when(got, "downloaded").otherwise("failed"),
        "parse_status": F.when(got & good, "parsed").when(got, "failed").otherwise("pending"),
    }).select(papers.columns)


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def duplicate_jobs(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """What is asked for though a job for it is under way."""
    return asked.join(jobs.where(is_active(F.col("status"))).select("paper_id").distinct(), "paper_id", "left_semi")


def with_messages(messages: DataFrame, conversations: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after pairs (conv_id, turn, question, answer) of messages were added."""
    each = F.explode(F.array(F.struct(F.col("turn").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    rows = pairs.select("conv_id", each.alias("x")).select("conv_id", "x.*")
    added = pairs.groupBy("conv_id").agg((2 * F.count(F.lit(1))).alias("__n"))
    counted = conversations.join(added, "conv_id", "left").withColumn("message_count", F.col("message_count") + F.coalesce("__n", F.lit(0))).drop("__n")
    return messages.unionByName(rows), counted


def without_deleted(conversations: DataFrame, user: str) -> DataFrame:
    return conversations.where((F.col("user_id") == user) & ~F.coalesce("deleted", F.lit(False)))


def locked_out(failures: DataFrame, who: str, at: str, most: int = 8, seconds: int = 900) -> DataFrame:
    """Each failure with whether its origin is locked out by it."""
    w = Window.partitionBy(who).orderBy("__s").rangeBetween(-seconds, 0)
    d = failures.withColumn("__s", F.unix_seconds(F.col(at).cast("timestamp")))
    return d.withColumn("locked", F.count(F.lit(1)).over(w) >= most).drop("__s")
