"""The operators' queries, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import chat_format, click_dedup, decontaminate, jaccard_join, language_model, mixing, periodic_runs, quality_rules, sharding, token_counts, token_files, toxicity, url_filters
from quarrystone.llm.common import id_crc32, read_table, shared_dir, words_of
from quarrystone.llm.tokenizer import Vocabulary

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: A conversation whose texts hold the template's control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learn=id_crc32(F.col("__id")) % 5 != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (id_crc32(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, no source more than four times over."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix_tokens(docs, mixing.Target(budget=1.0, most_repeats=4.0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs, rules)
    return out.select(F.col(f"{quality_rules.ROW}.doc_id").alias("doc_id"), *quality_rules.BASE, "base_failed", "kept", "rule")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(read_table(spark, sf_dir, "documents"), Vocabulary(spark), rule="most")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    vocabulary = Vocabulary(spark)
    return chat_format.digests(chat_format.format_turns(turns.unionByName(more), vocabulary), vocabulary).drop("n_tokens")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), 8)


def utc_hours(at: Column) -> Column:
    """Whole hours since 1970 of a time without a zone, taken as UTC whatever the session's zone."""
    return F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)


def utc_micros(at: Column) -> Column:
    within = F.minute(at).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return utc_hours(at) * 3_600_000_000 + within


def click_copies(clicks: DataFrame) -> DataFrame:
    """key, hour, level and digest of each row's copies 0 to click_id % 3."""
    d = clicks.where("click_id is not null and arrived_at is not null")
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int")))).withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    d = d.withColumn("hour", utc_hours(F.col("arrived_at")) + 6 * F.col("j") * (F.col("c") % 10))
    fields = [F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5), utc_micros(F.col("ts")), F.col("props"), F.col("c") % 3]
    text = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return d.select(F.col("click_id").cast("long").alias("key"), "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("level"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def op11_click_dedup(spark: SparkSession, sf_dir: str, batches: int = 12, rows_a_group: int = 2000) -> DataFrame:
    copies = click_copies(read_table(spark, sf_dir, "clicks"))
    least, most, first, last, n = copies.agg(F.min("level"), F.max("level"), F.min("hour"), F.max("hour"), F.count(F.lit(1))).first()
    root = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    numbers: list[int] = []
    if n:
        batch = F.floor((F.col("level") - least) * batches / (most - least + 1)).cast("int")
        copies.select("key", "hour", "digest", batch.alias("batch")).write.partitionBy("batch").parquet(f"{root}/copies")
        numbers = sorted(r[0] for r in spark.read.parquet(f"{root}/copies").select("batch").distinct().collect())
    folders = [(k, f"{root}/copies/batch={k}") for k in numbers]
    out = click_dedup.deduplicated(spark, folders, root, last_hour=last or 0, last_batch=batches - 1, buckets=max(1, n // (batches * rows_a_group)), origin=first or 0)
    return out.select(F.col("key").alias("click_id"), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("digest")).alias("hash"))


def planted_words(doc_id: Column, text: Column) -> Column:
    """The text; of an id whose crc32 ends in 0 the words from one place on repeat with one period."""
    h = id_crc32(doc_id)
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        """As a function, so that the words are split once and not for each place."""
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    made = F.get(F.transform(F.array(words_of(text)), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    d = periodic_runs.collapse(docs.select("doc_id", planted_words(F.col("doc_id"), F.col("text")).alias("text")))
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    kind = d.schema["runs"].dataType.elementType.simpleString()
    most = F.aggregate("runs", F.lit(None).cast(kind), lambda a, x: F.when(better(a, x), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    best = [F.col(f"most.{c}").alias(c) for c in ("start", "length", "period")]
    return d.select("doc_id", "n_runs", *best, F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_quality_rules, op4_jaccard_join, op5_lm_scoring, op6_token_counts, op7_chat_format, op8_url_filters, op9_decontaminate, op10_sharding, op11_click_dedup, op12_periodic_runs, op13_token_files)}


OP4_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id, doc_id AS node FROM sets UNION SELECT doc_id, b FROM reached JOIN links ON node = a),
least AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END::BIGINT AS n_copies FROM sets JOIN least USING (doc_id)"""

OP7_SQL = r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (SELECT *, length(regexp_replace(regexp_replace(role, '(\\*)(### |: |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS r,
  length(regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS t FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + r + 2 + t + 8)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op7_chat_format": OP7_SQL}
