"""Packing of passages into a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sentences end at one of ``.!?`` before white space; the mark can't be in a text as it stands.
MARK = "\u0001"


def sentences(text):
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + MARK), MARK)


def packed(d: DataFrame, budget: int = 25, text: str = "text") -> DataFrame:
    """(qid, rank, sentences, content): the budget is dealt evenly over the passages with
    text, what is left to the first ones."""
    full = d.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    w = Window.partitionBy("qid")
    full = full.withColumns({"nth": F.row_number().over(w.orderBy("rank")), "n": F.count(F.lit(1)).over(w)})
    share = F.floor(F.lit(budget) / F.col("n")) + F.when(F.col("nth") <= F.pmod(F.lit(budget), F.col("n")), 1).otherwise(0)
    full = full.withColumn("cap", share.cast("int")).where("cap > 0").withColumn("parts", sentences(F.trim(text)))
    return full.select("qid", "rank", F.least("cap", F.size("parts")).cast("long").alias("n_sentences"), F.trim(F.array_join(F.slice("parts", 1, F.col("cap")), " ")).alias("content"))


def prompt(packed_rows: DataFrame, title: str | None = None, section: str | None = None) -> DataFrame:
    """(qid, context): passages one after the other with a header each."""
    bits = [F.concat(F.lit("Source "), F.col("rank").cast("string"))]
    bits += [F.nullif(F.col(title), F.lit(""))] if title else []
    bits += [F.concat(F.lit("section="), F.nullif(F.col(section), F.lit("")))] if section else []
    line = F.concat(F.lit("["), F.concat_ws(" | ", *bits), F.lit("]\n"), F.col("content"))
    rows = packed_rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("qid", F.array_join(F.transform("x", lambda s: s["line"]), "\n\n").alias("context"))


def source_groups(d: DataFrame) -> DataFrame:
    """(qid, paper_id, title, refs): a paper's passages by number, bounded by the context's size."""
    return d.groupBy("qid", "paper_id").agg(F.min_by("title", "rank").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x.cast("string")), ",").alias("refs"))
