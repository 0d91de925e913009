"""Merging snapshots: upserts, edges, folds, audits.  A result is a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions.text import is_paper_id

#: Rules of the papers table, by column: what a new row does to an old one.
PAPER_RULES = {
    **dict.fromkeys(("title", "abstract", "authors", "categories", "pdf_url", "full_text", "local_pdf_path", "semantic_scholar_id"), "nonblank"),
    **dict.fromkeys(("published", "updated"), "nonnull"),
    **dict.fromkeys(("download_status", "parse_status", "layer", "source"), "overwrite"),
    "quality_score": "greatest",
    "is_seed": "or",
}
CHUNK_RULES = dict.fromkeys(("chunk_text", "section_hint", "token_count", "layer"), "overwrite")


def _merged(rule: str, old: Column, new: Column) -> Column:
    return {
        "nonblank": lambda: F.coalesce(F.nullif(new, F.lit("")), old),
        "nonnull": lambda: F.coalesce(new, old),
        "overwrite": lambda: new,
        "greatest": lambda: F.greatest(old, new),
        "or": lambda: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
        "keep": lambda: old,
    }[rule]()


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One full outer join by the key.  Columns without a rule keep their old value on
    conflict; keys must be unique on either side."""
    o, n = old.select(F.struct("*").alias("o"), F.col(key).alias("ok")), new.select(F.struct("*").alias("n"), F.col(key).alias("nk"))
    d = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    out = [F.coalesce("ok", "nk").alias(key)]
    for c in old.columns:
        if c != key:
            a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
            out.append(F.when(F.col("ok").isNull(), b).when(F.col("nk").isNull(), a).otherwise(_merged(rules.get(c, "keep"), a, b)).alias(c))
    return d.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the same key go, the new ones come."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def with_field(d: DataFrame, key: str, value, field: str, to) -> DataFrame:
    """One field of one row; only the fields that may be changed so; NUL is taken off."""
    if field not in config.CHANGEABLE:
        raise ValueError(f"{field} can't be changed")
    to = to.replace("\x00", "") if isinstance(to, str) else to
    return d.withColumn(field, F.when(F.col(key) == value, F.lit(to)).otherwise(F.col(field)))


def reset_text(d: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    marked = d.join(ids.select(key).distinct().withColumn("__on", F.lit(True)), key, "left")
    on = F.coalesce(F.col("__on"), F.lit(False))
    return marked.withColumns({"full_text": F.when(on, "").otherwise(F.col("full_text")), "parse_status": F.when(on, "pending").otherwise(F.col("parse_status"))}).drop("__on").select(d.columns)


def folded(d: DataFrame, key: str, order: str, nonblank: list[str], last: list[str]) -> DataFrame:
    """A row per key: for some columns the latest value that isn't blank, for others the latest."""
    at = lambda c: F.max_by(c, order)
    full = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))), F.lit(""))
    return d.groupBy(key).agg(*[full(c).alias(c) for c in nonblank], *[at(c).alias(c) for c in last])


def missing_text(papers: DataFrame, retry_failed: bool, limit: int | None = None, digits: str = "4,5") -> DataFrame:
    """Papers of proper id (``digits`` after the point) without a text, latest first (undated ones before all), but for those
    whose download failed or was skipped or whose text couldn't be parsed."""
    d = papers.where((F.trim(F.coalesce("full_text", F.lit(""))) == "") & is_paper_id(F.col("paper_id"), digits))
    if not retry_failed:
        d = d.where(~F.coalesce("download_status", F.lit("")).isin("failed", "skipped") & (F.coalesce("parse_status", F.lit("")) != "failed"))
    d = d.orderBy(F.desc_nulls_first("published"), "paper_id")
    return d.limit(limit) if limit is not None else d


def lookup(d: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, none where it isn't there: the test reaches the scan."""
    return d.where(F.col(key) == F.lit(value)).limit(1)


def exists(d: DataFrame, key: str, value) -> bool:
    return bool(lookup(d, key, value).take(1))


def of_paper(chunks: DataFrame, paper_id, key: str = "paper_id") -> DataFrame:
    """A paper's chunks in order."""
    return chunks.where(F.col(key) == F.lit(paper_id)).orderBy("chunk_index")


def seeds(papers: DataFrame) -> DataFrame:
    return papers.where(F.coalesce("is_seed", F.lit(False))).orderBy(F.asc_nulls_last("published"), "paper_id")


def work_items(papers: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    """What is left to do, with its place: items whose last try failed first, then by key.
    ``done`` (key, complete, failed) is the record of earlier runs."""
    d = papers.select(key).distinct().join(done.select(key, "complete", "failed"), key, "left")
    d = d.where(~F.coalesce("complete", F.lit(False))).select(key, F.coalesce("failed", F.lit(False)).alias("failed"))
    return d.orderBy(F.desc("failed"), key)


def deleted(d: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return d.join(ids.select(key).distinct(), key, "left_anti")


def truncated(d: DataFrame) -> DataFrame:
    return d.limit(0)


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.select(on).distinct().join(right.select(on).distinct(), on, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Children whose parent is gone go too."""
    return children.join(parents.select(on).distinct(), on, "left_semi")


def related(papers: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(of, paper...): what a paper refers to, or what cites it."""
    here, there = ("source", "target") if direction == "reference" else ("target", "source")
    e = edges.where(F.col("direction") == direction).select(F.col(here).alias("of"), F.col(there).alias("paper_id")).distinct()
    return e.join(papers, "paper_id")


def synced(papers: DataFrame, counts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Papers as the artifacts have them: quality by whether there are chunks, seeds marked."""
    c = counts.select("paper_id", F.col("n_chunks").alias("__n"))
    s = seeds.select("paper_id").distinct().withColumn("__seed", F.lit(True))
    d = papers.join(c, "paper_id", "left").join(s, "paper_id", "left")
    n = F.coalesce("__n", F.lit(0))
    return d.withColumns({"n_chunks": n.cast("long"), "quality_score": F.when(n > 0, 1.0).otherwise(0.5), "is_seed": F.coalesce("__seed", F.lit(False)), "download_status": F.lit("artifact_only")}).drop("__n", "__seed")
