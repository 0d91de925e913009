"""Queries of rules that stand between other steps: cascades, owners, jobs, errors, model output, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import prompts
from quarrystone.operators import admission, chat, tables
from quarrystone.plans.base import query, table
from quarrystone.sources import files


@query("fk_cascade", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o ON l_orderkey = o_orderkey")
def fk_cascade(spark, sf_dir):
    """Lines whose order is gone go with it."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.cascade(table(spark, sf_dir, "lineitem"), parents, "l_orderkey").select("l_orderkey", "l_linenumber")


OWNED = "owned AS (SELECT conv_id, 'u' || (conv_id % 3) AS user_id, CASE WHEN conv_id % 4 = 0 THEN true WHEN conv_id % 4 = 1 THEN false END AS deleted, max(turn) AS updated FROM conversations GROUP BY conv_id)"


def owned(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    deleted = F.when(F.col("conv_id") % 4 == 0, True).when(F.col("conv_id") % 4 == 1, False)
    return c.select("conv_id", F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user_id"), deleted.alias("deleted"), "updated")


@query("owned_conversations", f"WITH {OWNED} SELECT conv_id, updated FROM owned WHERE user_id = 'u1' AND NOT coalesce(deleted, false)")
def owned_conversations(spark, sf_dir):
    return admission.without_deleted(owned(spark, sf_dir), "u1").select("conv_id", "updated")


@query("soft_delete", f"WITH {OWNED} SELECT conv_id, coalesce(deleted, false) OR (user_id = 'u2' AND conv_id % 5 = 0) AS deleted FROM owned")
def soft_delete(spark, sf_dir):
    """Conversations that their owner deletes are marked, others' stay as they are."""
    asked = owned(spark, sf_dir).where("conv_id % 5 = 0").select("conv_id")
    return chat.soft_deleted(owned(spark, sf_dir), asked, "u2").select("conv_id", "deleted")


STATUS = "CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'downloading' WHEN 2 THEN 'chunking' WHEN 3 THEN 'embedding' WHEN 4 THEN 'done' ELSE 'failed' END"


@query("duplicate_jobs", f"SELECT DISTINCT user_id AS paper_id FROM events SEMI JOIN (SELECT user_id FROM (SELECT user_id, {STATUS} AS status, event_id FROM events) WHERE event_id % 10 = 3 AND status IN ('queued', 'downloading', 'chunking', 'embedding')) j USING (user_id)")
def duplicate_jobs(spark, sf_dir):
    """What is asked for though a job of one of four states is under way for it."""
    e = table(spark, sf_dir, "events").withColumn("paper_id", F.col("user_id"))
    names = F.array(*[F.lit(s) for s in (*admission.ACTIVE, "done", "failed")])
    jobs = e.where("event_id % 10 = 3").select("paper_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("status"))
    return admission.duplicate_jobs(jobs, e.select("paper_id").distinct())


@query("error_kinds", f"SELECT page_id, regexp_matches(lower(CASE page_id % 4 WHEN 0 THEN 'HTTP 429 at ' || url WHEN 1 THEN 'Rate limit: ' || url WHEN 2 THEN 'Timeout at ' || url END), '{'|'.join(prompts.RATE_LIMIT)}') IS TRUE AS limited FROM pages")
def error_kinds(spark, sf_dir):
    k = F.col("page_id") % 4
    error = F.when(k == 0, F.concat(F.lit("HTTP 429 at "), "url")).when(k == 1, F.concat(F.lit("Rate limit: "), "url")).when(k == 2, F.concat(F.lit("Timeout at "), "url"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(prompts.is_rate_limit(error), F.lit(False)).alias("limited"))


ANSWER = "'Here:' || chr(10) || '1. ' || text || chr(10) || ' 2.  What of ' || item_id || '? ' || chr(10) || '3.' || chr(10) || 'no' || chr(10) || '4. last'"


@query("expansion_lines", f"""SELECT item_id, list_filter(list_transform(regexp_extract_all({ANSWER}, '(?m)^\\s*\\d+\\.\\s*(.+)$', 1)[1:3], lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> lower(text)) AS variants FROM benchmark WHERE NOT contains(text, chr(10))""".replace("SELECT item_id, list_filter", "SELECT item_id, array_to_string(list_filter").replace("lower(text)) AS", "lower(text)), '|') AS"))
def expansion_lines(spark, sf_dir):
    """What a model lists by number, without the question itself."""
    b = table(spark, sf_dir, "benchmark").where(~F.contains("text", F.lit("\n")))
    answer = F.concat(F.lit("Here:\n1. "), "text", F.lit("\n 2.  What of "), F.col("item_id").cast("string"), F.lit("? \n3.\nno\n4. last"))
    return b.select("item_id", F.array_join(prompts.numbered_lines(answer, F.col("text")), "|").alias("variants"))


@query("artifact_digests", "SELECT doc_id AS paper_id, sha256(text) AS sha256 FROM documents")
def artifact_digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.encode("text", "UTF-8").alias("content"))
    return files.digest(d)


@query("truncated_table", "SELECT doc_id, lang FROM documents WHERE false")
def truncated_table(spark, sf_dir):
    return tables.truncated(table(spark, sf_dir, "documents")).select("doc_id", "lang")
