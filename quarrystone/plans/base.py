"""The test tables as the engine's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import layer_of

AS_OF = "2025-06-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that it is held against."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _widened(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _widened(d: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as SQL counts and ranks have them."""
    return d.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in d.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: dated by id, titled by the text's beginning; the abstract is all of it."""
    d = table(spark, sf_dir, "documents")
    published = F.date_add(F.to_date(F.lit("2015-01-01")), (F.col("doc_id") % 4000).cast("int"))
    return d.select(
        "doc_id", F.col("doc_id").alias("paper_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("authors"), F.col("lang").alias("categories"),
        published.alias("published"), layer_of(F.year(published)).alias("layer"), (F.col("doc_id") % 50 == 0).alias("is_seed"), "text",
    )


LAYER_SQL = "CASE WHEN year(published) <= 2019 THEN 'prerequisite' WHEN year(published) <= 2022 THEN 'foundation' WHEN year(published) <= 2024 THEN 'core' ELSE 'latest' END"
PAPERS_SQL = f"""papers AS (
  SELECT *, {LAYER_SQL} AS layer FROM (
    SELECT doc_id, doc_id AS paper_id, substring(text, 1, 60) AS title, text AS abstract, source AS authors, lang AS categories,
      DATE '2015-01-01' + (doc_id % 4000)::INTEGER AS published, doc_id % 50 = 0 AS is_seed, text FROM documents))"""


def tokens_sql(col: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"


#: Index tables and scores of questions (qid, text) over documents.
BM25_SQL = rf"""toks AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS len FROM toks),
stats AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
raws AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def scores_sql(questions: str, keys: str = "qid") -> str:
    return rf"""(SELECT {keys}, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 4) AS score
  FROM (SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest({tokens_sql('text')}) AS term FROM {questions}) GROUP BY ALL) q
  JOIN postings USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), stats GROUP BY {keys}, doc_id)"""


def intent_sql(col: str) -> str:
    from quarrystone import config
    from quarrystone.functions.query import any_of

    rules = " ".join(f"WHEN regexp_matches(trim({col}), '{any_of(p)}') THEN '{i}'" for i, p in config.INTENT_PHRASES)
    return rf"CASE {rules} WHEN trim({col}) LIKE '%?' AND len(list_filter(string_split_regex(trim({col}), '\s+'), lambda x: x <> '')) <= 8 THEN 'explanatory' ELSE 'discovery' END"


def budget_sql(intent: str, field: str) -> str:
    from quarrystone import config

    return f"CASE {intent} " + " ".join(f"WHEN '{i}' THEN {getattr(b, field)}" for i, b in config.BUDGETS.items()) + " END"
