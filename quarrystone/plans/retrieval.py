"""Queries of retrieval: lexical, dense, fused, boosted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions.query import gate_of, intent_of, is_summary, variants_of
from quarrystone.functions.text import grounding_share
from quarrystone.operators import context as packing
from quarrystone.operators import dense, fusion, holding, lexical, reports
from quarrystone.plans import retrieve as whole
from quarrystone.plans.base import BM25_SQL, PAPERS_SQL, budget_sql, intent_sql, papers, query, scores_sql, table, tokens_sql
from quarrystone.sources.shared import few, kept


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


QUESTIONS = "questions AS (SELECT item_id AS qid, text FROM benchmark)"


def index_of(spark, sf_dir):
    return lexical.of_snapshot(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet")


def rank_sql(source: str, most: str, ties: str = "doc_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {ties}) AS rank FROM {source}) WHERE rank <= {most})"


@query("bm25_topk", f"WITH {QUESTIONS}, {BM25_SQL}, scored AS {scores_sql('questions')} SELECT qid, doc_id, score, rank FROM {rank_sql('(SELECT * FROM scored WHERE score > 0)', '10')}")
def bm25_topk(spark, sf_dir):
    return lexical.top(index_of(spark, sf_dir), questions(spark, sf_dir), 10).select("qid", "doc_id", "score", "rank")


@query(
    "bm25_filtered_posttopk",
    f"""WITH {QUESTIONS}, {BM25_SQL}, scored AS {scores_sql('questions')},
five AS {rank_sql('(SELECT * FROM scored WHERE score > 0)', '50')},
kept AS (SELECT qid, doc_id, score FROM five JOIN documents USING (doc_id) WHERE contains(lower(lang), 'en') AND contains(lower(source), 'src1'))
SELECT qid, doc_id, score, rank FROM {rank_sql('kept', '30')}""",
)
def bm25_filtered(spark, sf_dir):
    keep = F.contains(F.lower("lang"), F.lit("en")) & F.contains(F.lower("source"), F.lit("src1"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return lexical.top_then_filter(index_of(spark, sf_dir), questions(spark, sf_dir), docs, keep, 10)


VARIANTS = "(SELECT item_id AS qid, 0 AS v, text FROM benchmark UNION ALL SELECT item_id, 1, substring(text, 1, 40) FROM benchmark UNION ALL SELECT item_id, 2, substring(text, 41, 40) FROM benchmark)"


@query("bm25_multi_variant_max", f"WITH {BM25_SQL}, scored AS (SELECT qid, doc_id, max(score) AS score FROM {scores_sql(VARIANTS, 'qid, v')} GROUP BY ALL) SELECT qid, doc_id, score, rank FROM {rank_sql('(SELECT * FROM scored WHERE score > 0)', '10')}")
def bm25_variants(spark, sf_dir):
    q = questions(spark, sf_dir).select("qid", F.posexplode(F.array(F.col("text"), F.substring("text", 1, 40), F.substring("text", 41, 40))).alias("v", "text"))
    return lexical.top(index_of(spark, sf_dir), q, 10, variant="v").select("qid", "doc_id", "score", "rank")


@query("bm25_stats", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term)")
def bm25_stats(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "fts_weighted",
    f"""WITH {PAPERS_SQL}, {QUESTIONS},
held AS (SELECT DISTINCT doc_id, term, w FROM (SELECT doc_id, unnest({tokens_sql('title')}) AS term, 1.0::DOUBLE AS w FROM papers UNION ALL SELECT doc_id, unnest({tokens_sql('abstract')}), 0.4::DOUBLE FROM papers UNION ALL SELECT doc_id, unnest({tokens_sql('authors')}), 0.2::DOUBLE FROM papers UNION ALL SELECT doc_id, unnest({tokens_sql('text')}), 0.1::DOUBLE FROM papers)),
q AS (SELECT DISTINCT qid, unnest({tokens_sql('text')}) AS term FROM questions),
scored AS (SELECT qid, doc_id, round(sum(w), 4) AS score FROM q JOIN held USING (term) GROUP BY ALL)
SELECT qid, doc_id, score, rank FROM {rank_sql('scored JOIN (SELECT doc_id, published FROM papers) USING (doc_id)', '10', 'published DESC NULLS LAST, doc_id')}""",
)
def fts_weighted(spark, sf_dir):
    p = papers(spark, sf_dir)
    found = lexical.weighted_fields(p, questions(spark, sf_dir), {"title": 1.0, "abstract": 0.4, "authors": 0.2, "text": 0.1})
    return lexical.ranked(found.join(p.select("doc_id", "published"), "doc_id"), ["qid"], 10, F.desc_nulls_last("published")).select("qid", "doc_id", "score", "rank")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def asked(spark, sf_dir, every: int = 20):
    """Vectors of every id divisible by ``every``: their number follows the table."""
    return vectors(spark, sf_dir).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def asked_by_items(spark, sf_dir):
    """The vector of every question of the benchmark: that of its own id."""
    q = questions(spark, sf_dir).select("qid").distinct()
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "qid").join(F.broadcast(q), "qid", "left_semi").select("qid", F.col("embedding").alias("vector"))


DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
DENSE = f"dense AS (SELECT a.vec_id AS qid, b.vec_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"
DENSE_ITEMS = DENSE.replace("a.vec_id % 20 = 0", "a.vec_id IN (SELECT item_id FROM benchmark)")


@query("dense_topk", f"WITH {DENSE} SELECT qid, vec_id, score, rank FROM {rank_sql('dense', '20', 'vec_id')}")
def dense_topk(spark, sf_dir):
    return dense.top(vectors(spark, sf_dir), asked(spark, sf_dir), 20)


@query("dense_topk_filtered", f"WITH {DENSE} SELECT qid, vec_id, score, rank FROM {rank_sql('(SELECT dense.* FROM dense JOIN embeddings USING (vec_id) WHERE label % 3 = 0)', '20', 'vec_id')}")
def dense_filtered(spark, sf_dir):
    return dense.top(vectors(spark, sf_dir).where("label % 3 = 0"), asked(spark, sf_dir), 20)


@query("dense_variants_maxmerge", f"WITH {DENSE}, each AS {rank_sql('dense', '20', 'vec_id')}, best AS (SELECT qid % 10 AS qid, vec_id, max(score) AS score FROM each GROUP BY ALL) SELECT qid, vec_id, score, rank FROM {rank_sql('best', '60', 'vec_id')}")
def dense_variants(spark, sf_dir):
    found = dense.top(vectors(spark, sf_dir), asked(spark, sf_dir), 20)
    return dense.best_variant(found.withColumn("qid", F.col("qid") % 10), "vec_id", 60).select("qid", "vec_id", "score", "rank")


CENTROIDS = """means AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM means GROUP BY label),
parents AS (SELECT label, list(x / norm ORDER BY i) AS v FROM means JOIN norms USING (label) GROUP BY label)"""


@query(
    "parent_child_expand",
    f"""WITH {CENTROIDS}, {DENSE},
docs AS (SELECT a.vec_id AS qid, parents.label, round(list_dot_product(a.embedding::DOUBLE[], v), 6) AS score FROM embeddings a, parents WHERE a.vec_id % 20 = 0),
top AS {rank_sql('docs', '5', 'label')},
kids AS (SELECT top.qid, label, vec_id, round(greatest(1e-6, top.score) * greatest(1e-6, dense.score), 6) AS score, row_number() OVER (PARTITION BY top.qid, label ORDER BY dense.score DESC, vec_id) AS nth
  FROM top JOIN embeddings USING (label) JOIN dense USING (qid, vec_id))
SELECT qid, label::BIGINT AS label, vec_id, score FROM kids WHERE nth <= 10""",
)
def parent_child(spark, sf_dir):
    """Best parents, and of each its ten best chunks; scores multiply."""
    v, q = vectors(spark, sf_dir), asked(spark, sf_dir)
    return whole.within_parents(dense.centroids(v, "label"), v, q, 5, parent="label", key="vec_id").withColumn("label", F.col("label").cast("long"))


@query(
    "similar_papers",
    f"""WITH {CENTROIDS},
near AS (SELECT label AS qid, vec_id, e.label AS paper, round(list_dot_product(e.embedding::DOUBLE[], p.v), 6) AS score FROM (SELECT label, v FROM parents) p, embeddings e WHERE e.label <> p.label),
hundred AS {rank_sql('(SELECT qid, vec_id, paper, score FROM near)', '100', 'vec_id')},
firsts AS (SELECT qid, paper, max(score) AS score FROM hundred GROUP BY ALL)
SELECT qid::BIGINT AS qid, paper::BIGINT AS paper, round(score, 4) AS similarity, rank FROM {rank_sql('firsts', '5', 'paper')}""".replace("SELECT label AS qid, vec_id", "SELECT p.label AS qid, vec_id"),
)
def similar_papers(spark, sf_dir):
    """From the hundred chunks nearest to a paper's mean vector, others' best by paper."""
    v = vectors(spark, sf_dir)
    q = dense.centroids(v, "label").select(F.col("label").alias("qid"), "vector")
    found = dense.top(v, q, 100, own="label").join(v.select("vec_id", F.col("label").alias("paper")), "vec_id")
    firsts = found.groupBy("qid", "paper").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "paper")
    return firsts.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("qid", "paper", F.round("score", 4).alias("similarity"), "rank")


def arms(spark, sf_dir):
    """Lexical and dense ranks of each question over documents; a document's vector is its own id's."""
    q = questions(spark, sf_dir)
    lex = lexical.top(index_of(spark, sf_dir), q, 60)
    d = dense.top(vectors(spark, sf_dir), asked_by_items(spark, sf_dir), 60).withColumnRenamed("vec_id", "doc_id")
    return d, lex, q.select("qid", intent_of(F.col("text")).alias("intent"), is_summary(F.col("text")).alias("summary"))


FUSED = f"""{QUESTIONS}, {BM25_SQL}, {DENSE_ITEMS}, scored AS {scores_sql('questions')},
lex AS {rank_sql('(SELECT * FROM scored WHERE score > 0)', '60')}, den AS {rank_sql('(SELECT qid, vec_id AS doc_id, score FROM dense)', '60')},
intents AS (SELECT qid, {intent_sql('text')} AS intent FROM questions),
pairs AS (SELECT qid, doc_id, den.rank AS dense_rank, lex.rank AS lexical_rank FROM den FULL JOIN lex USING (qid, doc_id)),
fused AS (SELECT pairs.*, intent, round(coalesce({budget_sql('intent', 'dense_weight')}::DOUBLE / (60 + dense_rank), 0) + coalesce({budget_sql('intent', 'lexical_weight')}::DOUBLE / (60 + lexical_rank), 0), 6) AS score FROM pairs JOIN intents USING (qid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) AS rank FROM fused)"""


@query("hybrid_rrf", f"WITH {FUSED} SELECT qid, doc_id, intent, score, rank FROM ranked WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    return fusion.fused(*arms(spark, sf_dir), most=20).select("qid", "doc_id", "intent", "score", "rank")


@query("hybrid_budgeted", f"WITH {FUSED} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= {budget_sql('intent', 'merged')}")
def hybrid_budgeted(spark, sf_dir):
    return fusion.fused(*arms(spark, sf_dir)).select("qid", "doc_id", "score", "rank")


def pool(spark, sf_dir, most=60):
    """Fused candidates with their papers (source stands for the paper, to have several chunks each)."""
    p = papers(spark, sf_dir).select("doc_id", F.col("authors").alias("paper_id"), "categories", "published", "layer", F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (F.col("doc_id") % len(SECTIONS) + 1).cast("int")).alias("section"), "text")
    return few(fusion.fused(*arms(spark, sf_dir), most=most), "fused").join(p, "doc_id")


SECTIONS = ("abstract", "introduction", "background", "method", "experiments", "results", "related_work", "other")
POOL = f"""{PAPERS_SQL}, {FUSED},
pool AS (SELECT r.*, p.authors AS paper_id, p.categories, p.published, p.layer, ['{"','".join(SECTIONS)}'][doc_id % {len(SECTIONS)} + 1] AS section, p.text FROM ranked r JOIN papers p USING (doc_id) WHERE rank <= 60)"""


def again_sql(source: str) -> str:
    return f"(SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, doc_id) AS rank) FROM {source})"


@query(
    "rrf_boosted_capped",
    f"""WITH {POOL},
lifted AS {again_sql("(SELECT * REPLACE (round(score + CASE WHEN layer = 'latest' AND intent <> 'explanatory' THEN 0.001 ELSE 0 END, 6) AS score) FROM pool)")},
strong AS (SELECT * FROM lifted WHERE intent <> 'explanatory' OR rank <= 3 OR section IN ('method', 'abstract', 'introduction', 'background') OR regexp_matches(lower(text), 'we propose|method|pipeline|architecture|algorithm|training|approach|framework|results|evaluation')),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, paper_id ORDER BY rank) AS nth FROM strong) WHERE nth <= 4)
SELECT qid, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM capped) WHERE intent NOT IN ('technical', 'explanatory', 'evidence', 'sota') OR score >= least(top, greatest(0.2, 0.7 * top))""",
)
def boosted_capped(spark, sf_dir):
    d = fusion.pruned(fusion.reranked(fusion.boosted_latest(pool(spark, sf_dir))))
    return fusion.above_threshold(fusion.capped(d), F.col("intent")).select("qid", "doc_id", "score", "rank")


@query("summary_boost", f"WITH {POOL} SELECT qid, doc_id, round(score + CASE section WHEN 'abstract' THEN 0.03 WHEN 'introduction' THEN 0.025 WHEN 'background' THEN 0.01 WHEN 'method' THEN 0.01 WHEN 'results' THEN 0.01 ELSE 0 END, 6) AS score FROM pool")
def summary_boost(spark, sf_dir):
    return fusion.boosted_summary(pool(spark, sf_dir), F.lit(True)).select("qid", "doc_id", "score")


def _factors() -> str:
    from quarrystone import config

    rows = [f"WHEN section = '{s}' AND intent = '{i}' THEN {config.SECTION_WEIGHTS[s]} * {x}" for i, p in config.SECTION_PREFERENCES.items() for s, x in p.items()]
    rows += [f"WHEN section = '{s}' THEN {w}" for s, w in config.SECTION_WEIGHTS.items()]
    return "CASE " + " ".join(rows) + " ELSE 1.0 END"


@query("section_recency_boost", f"WITH {POOL} SELECT qid, doc_id, round((100 * score * ({_factors()})::DOUBLE * CASE WHEN intent = 'sota' AND published >= DATE '2025-06-01' - 540 THEN 1.25 ELSE 1.0 END::DOUBLE), 10) AS score FROM pool")
def section_recency(spark, sf_dir):
    d = pool(spark, sf_dir)
    factor = fusion.section_factor(F.col("section"), F.col("intent")) * fusion.recency_factor(F.col("published"), F.col("intent"), "2025-06-01")
    return d.select("qid", "doc_id", F.round(100 * F.col("score") * factor, 10).alias("score"))


@query("year_filter", f"WITH {POOL} SELECT qid, doc_id, rank FROM pool WHERE paper_id <> '' AND (doc_id % 7 = 0 OR year(published) >= 2020)")
def year_filter(spark, sf_dir):
    return fusion.after_year(pool(spark, sf_dir), 2020, F.col("doc_id") % 7 != 0).select("qid", "doc_id", "rank")


@query(
    "citation_boost",
    f"""WITH {POOL}, edges AS (SELECT DISTINCT l_suppkey % 1000 AS source, l_partkey % 1000 AS target FROM lineitem),
ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
seeds AS (SELECT DISTINCT qid, doc_id FROM pool WHERE rank <= 25),
near AS (SELECT DISTINCT qid, target AS doc_id FROM seeds JOIN ways ON doc_id = source EXCEPT SELECT qid, doc_id FROM seeds)
SELECT qid, doc_id, round(score + CASE WHEN near.doc_id IS NOT NULL AND intent NOT IN ('technical', 'evidence', 'explanatory') THEN 0.004 ELSE 0 END, 6) AS score FROM pool LEFT JOIN near USING (qid, doc_id)""",
)
def citation_boost(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 1000).alias("source"), (F.col("l_partkey") % 1000).alias("target")).distinct()
    d = pool(spark, sf_dir).drop("paper_id").withColumn("paper_id", F.col("doc_id"))
    return fusion.boosted_citations(d, e).select("qid", "doc_id", "score")


@query(
    "layer_coverage",
    f"""WITH {POOL}, marked AS (SELECT *, layer IN ('prerequisite', 'foundation') AS base, doc_id % 5 AS x FROM pool WHERE doc_id % 5 <> 0 OR rank > 10),
sized AS (SELECT *, least(5, count(*) OVER (PARTITION BY qid)) AS size FROM (SELECT qid, doc_id, base, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM marked)),
flags AS (SELECT *, max(CASE WHEN rank <= 5 AND base THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS has, min(CASE WHEN base THEN rank END) OVER (PARTITION BY qid) AS best FROM sized)
SELECT qid, doc_id, rank FROM flags WHERE CASE WHEN has = 0 AND best IS NOT NULL THEN rank < size OR rank = best ELSE rank <= 5 END""",
)
def layer_coverage(spark, sf_dir):
    d = pool(spark, sf_dir).where("doc_id % 5 <> 0 or rank > 10")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return fusion.with_foundation(d, 5).select("qid", "doc_id", "rank")


@query("mmr_select")
def mmr_select(spark, sf_dir):
    """Greedy selection over each question's nearest vectors: no SQL states it."""
    found = dense.top(vectors(spark, sf_dir), asked(spark, sf_dir), 40)
    d = found.withColumn("intent", F.lit("discovery"))
    return fusion.mmr(d, vectors(spark, sf_dir), 10, key="vec_id")


@query(
    "diversify",
    f"""WITH {POOL}, late AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, paper_id ORDER BY rank) > 2 THEN 1 ELSE 0 END AS late FROM pool)
SELECT qid, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY late, rank) AS position FROM late) WHERE position <= 12""",
)
def diversify(spark, sf_dir):
    return fusion.diversified(pool(spark, sf_dir), 12, per_paper=2).select("qid", "doc_id", "position")


@query("diversify_sections")
def diversify_sections(spark, sf_dir):
    """Section novelty with backfill over every question's pool: greedy, held against a twin in the tests."""
    return fusion.novel(pool(spark, sf_dir), 12, per_paper=2)


@query(
    "result_analytics",
    f"""WITH {POOL}, named AS (SELECT qid, 'author' AS kind, paper_id AS name FROM pool UNION ALL SELECT qid, 'category', categories FROM pool),
counts AS (SELECT qid, kind, name, count(*) AS n FROM named GROUP BY ALL)
SELECT qid, kind, name, n FROM (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY n DESC, name) AS k FROM counts) WHERE k <= 5
UNION ALL SELECT qid, 'layer', layer, count(*) FROM pool GROUP BY ALL UNION ALL SELECT qid, 'papers', 'unique', count(DISTINCT paper_id) FROM pool GROUP BY qid""",
)
def result_analytics(spark, sf_dir):
    return reports.result_analytics(pool(spark, sf_dir).withColumn("authors", F.col("paper_id")))


TAKE = "list_filter(string_split_regex(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true)"


@query(
    "context_pack",
    f"""WITH {POOL}, full_ AS (SELECT qid, rank, text, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth, count(*) OVER (PARTITION BY qid) AS n FROM pool WHERE rank <= 7 AND trim(text) <> ''),
caps AS (SELECT qid, rank, {TAKE} AS parts, 25 // n + CASE WHEN nth <= 25 % n THEN 1 ELSE 0 END AS cap FROM full_)
SELECT qid, rank, least(cap, len(parts)) AS n_sentences, trim(array_to_string(parts[1:cap], ' ')) AS content FROM caps WHERE cap > 0""",
)
def context_pack(spark, sf_dir):
    return packing.packed(pool(spark, sf_dir, 7)).select("qid", "rank", "n_sentences", "content")


@query("source_groups", f"WITH {POOL} SELECT qid, paper_id, arg_min(substring(text, 1, 60), rank) AS title, array_to_string(list(rank ORDER BY rank), ',') AS refs FROM pool WHERE rank <= 10 GROUP BY ALL")
def source_groups(spark, sf_dir):
    return packing.source_groups(pool(spark, sf_dir, 10).withColumn("title", F.substring("text", 1, 60)))


RELEVANT = "rel AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevant(spark, sf_dir):
    """A question's relevant documents hold its text."""
    return holding.holding(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


METRICS = f"""WITH {QUESTIONS}, {BM25_SQL}, scored AS {scores_sql('questions')}, {RELEVANT},
found AS {rank_sql('(SELECT * FROM scored WHERE score > 0)', '10')},
hits AS (SELECT qid, sum((rank <= 5)::INT) AS h5, sum((rank <= 10)::INT) AS h10, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS g5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS g10, min(rank) AS first FROM found JOIN rel USING (qid, doc_id) GROUP BY qid),
counts AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
ideal AS (SELECT qid, n, list_sum([1 / log2(i + 1) for i in range(1, least(5, n) + 1)]) AS i5, list_sum([1 / log2(i + 1) for i in range(1, least(10, n) + 1)]) AS i10 FROM counts),
each AS (SELECT qid, round(coalesce(h5 / n, 0), 6) AS recall_5, round(coalesce(h5, 0) / 5.0::DOUBLE, 6) AS precision_5, round(coalesce(g5 / i5, 0), 6) AS ndcg_5, round(coalesce(h10 / n, 0), 6) AS recall_10, round(coalesce(h10, 0) / 10.0::DOUBLE, 6) AS precision_10, round(coalesce(g10 / i10, 0), 6) AS ndcg_10, round(coalesce(1 / first, 0), 6) AS mrr
  FROM questions LEFT JOIN hits USING (qid) LEFT JOIN ideal USING (qid))"""


def each_metric(spark, sf_dir):
    q = questions(spark, sf_dir)
    return reports.metrics(lexical.top(index_of(spark, sf_dir), q, 10), relevant(spark, sf_dir), q)


@query("eval_metrics", f"{METRICS} SELECT * FROM each")
def eval_metrics(spark, sf_dir):
    return each_metric(spark, sf_dir)


LITERALS = (
    "What is attention?", "transformers vs RNNs for translation", "latest results 2025", "prove the theorem of eq. 3 in 2301.12345", 'find "self attention" and "residual stream"',
    "empirical evidence for superposition", "sparse autoencoders", "summarize this paper", "$ab$ and $cd$ norms", "pros and cons of layer norm", "", "Is it so?",
)


MARKED = f"CASE WHEN {{id}} % 3 = 0 THEN {list(LITERALS)}[{{id}} // 3 % {len(LITERALS)} + 1] || ' ' || text ELSE text END"


@query("eval_by_intent", f"{METRICS} SELECT intent, count(*) AS n, round(avg(recall_10), 4) AS recall_10, round(avg(ndcg_10), 4) AS ndcg_10, round(avg(mrr), 4) AS mrr FROM (SELECT each.*, {intent_sql('(' + MARKED.format(id='item_id') + ')')} AS intent FROM each JOIN benchmark ON item_id = qid) GROUP BY ROLLUP (intent)")
def eval_by_intent(spark, sf_dir):
    asked = marked_questions(spark, sf_dir).where("source = 'benchmark'").select(F.col("id").alias("qid"), intent_of(F.col("text")).alias("intent"))
    d = each_metric(spark, sf_dir).join(asked, "qid")
    return reports.averages(d, "intent", ["recall_10", "ndcg_10", "mrr"])


@query("doc_recall", f"WITH {QUESTIONS}, {BM25_SQL}, scored AS {scores_sql('questions')}, {RELEVANT}, found AS {rank_sql('(SELECT * FROM scored WHERE score > 0)', '10')}, f AS (SELECT DISTINCT qid, source FROM found JOIN documents USING (doc_id)), r AS (SELECT DISTINCT qid, source FROM rel JOIN documents USING (doc_id)) SELECT r.qid, round(count(f.source) / count(*), 6) AS doc_recall FROM r LEFT JOIN f USING (qid, source) GROUP BY r.qid")
def doc_recall(spark, sf_dir):
    of = table(spark, sf_dir, "documents").select("doc_id", "source")
    f = few(lexical.top(index_of(spark, sf_dir), questions(spark, sf_dir), 10), "found").join(of, "doc_id").select("qid", "source").distinct().withColumn("on", F.lit(1))
    r = relevant(spark, sf_dir).join(of, "doc_id").select("qid", "source").distinct()
    return r.join(f, ["qid", "source"], "left").groupBy("qid").agg(F.round(F.count("on") / F.count(F.lit(1)), 6).alias("doc_recall"))


@query("query_intent", f"SELECT conv_id, turn, {intent_sql('text')} AS intent FROM conversations")
def query_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent_of(F.col("text")).alias("intent"))


LITERAL_SQL = f"questions AS (SELECT 'benchmark' AS source, item_id AS id, NULL::BIGINT AS turn, {MARKED.format(id='item_id')} AS text FROM benchmark UNION ALL SELECT 'conversations', conv_id, turn, {MARKED.format(id='conv_id')} FROM conversations)"


def marked_questions(spark, sf_dir):
    """All questions; a third of them with words before that a gate looks for."""
    k = F.col("id")
    word = F.get(F.array(*[F.lit(t) for t in LITERALS]), (F.floor(k / 3) % len(LITERALS)).cast("int"))
    return all_questions(spark, sf_dir).withColumn("text", F.when(k % 3 == 0, F.concat(word, F.lit(" "), "text")).otherwise(F.col("text")))


@query(
    "query_gate",
    rf"""WITH {LITERAL_SQL}, i AS (SELECT source, id, turn, text, {intent_sql('text')} AS intent FROM questions),
f AS (SELECT source, id, turn, intent, intent IN ('technical', 'comparative', 'evidence') AS formal, regexp_matches(lower(text), '\b(?:arxiv:)?\d{{4}}\.\d{{4,5}}\b') AS exact, len(regexp_extract_all(text, '\$[^$]{{2,}}\$')) >= 2 OR contains(text, '\begin{{') OR contains(text, '_{{}}') AS tex, regexp_matches(lower(text), '\b(?:eq\.?|equation)\s*\d+') AS num, len(regexp_extract_all(text, '"')) >= 2 AS quoted FROM i)
SELECT source, id, turn, intent, exact AS restrict_decompose, formal OR exact OR tex OR num AS restrict_embedding_expansion, formal OR exact OR tex OR quoted AS restrict_llm_expansion FROM f""",
)
def query_gate(spark, sf_dir):
    d = marked_questions(spark, sf_dir).withColumn("intent", intent_of(F.col("text")))
    return d.select("source", "id", "turn", "intent", *[c.alias(n) for n, c in gate_of(F.col("text"), F.col("intent")).items()])


def all_questions(spark, sf_dir):
    """(source, id, turn, text): benchmark items, without a turn, and all turns of conversations."""
    items = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").cast("long").alias("id"), F.lit(None).cast("long").alias("turn"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    return items.unionByName(turns)


@query("query_decompose")
def query_decompose(spark, sf_dir):
    """Variants of every question of both tables, one a row; held against a plain-Python twin in the tests."""
    d = all_questions(spark, sf_dir).withColumn("intent", intent_of(F.col("text")))
    return d.select("source", "id", "turn", F.posexplode(variants_of(F.col("text"), F.col("intent"))).alias("place", "variant"))


def corpus_of(spark, sf_dir) -> whole.Corpus:
    p = papers(spark, sf_dir)
    chunks = p.select("doc_id", F.col("authors").alias("paper_id"), "title", "authors", "categories", "published", "layer", F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (F.col("doc_id") % len(SECTIONS) + 1).cast("int")).alias("section"), "text")
    source = f"{sf_dir}/documents.parquet"
    vectors = kept(spark, source, "vectors", lambda: whole.encoded(p.select("doc_id", "text"), name="embedding").select("doc_id", "embedding"))
    of_papers = vectors.join(chunks.select("doc_id", "paper_id"), "doc_id").where("paper_id is not null")
    parents = kept(spark, source, "parents", lambda: dense.centroids(of_papers, "paper_id"))
    return whole.Corpus(chunks, vectors, index_of(spark, sf_dir), parents=parents)


@query("retrieve_full")
def retrieve_full(spark, sf_dir):
    """The whole way to passages, with the default encoder and reranker: no SQL states its greedy steps."""
    return whole.retrieve(corpus_of(spark, sf_dir), questions(spark, sf_dir), as_of="2025-06-01")


@query("retrieve_filtered")
def retrieve_filtered(spark, sf_dir):
    return whole.retrieve(corpus_of(spark, sf_dir), questions(spark, sf_dir), as_of="2025-06-01", filters=whole.Filters(category="en", start_year=2016))


@query("ablation_variants")
def ablation_variants(spark, sf_dir):
    return whole.ablation(corpus_of(spark, sf_dir), questions(spark, sf_dir), list(whole.ABLATIONS), as_of="2025-06-01", top_n=5)


@query("grounding_check", "WITH pairs AS (SELECT a.conv_id, a.turn, lower(a.text) AS answer, lower(b.text) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'), w AS (SELECT *, list_distinct(regexp_extract_all(answer, '[a-z]{6,}')) AS words FROM pairs) SELECT conv_id, turn, round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(context, x))) / len(words) ELSE 1 END, 4) AS share, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(context, x))) / len(words) ELSE 1 END < 0.25 AS warned FROM w")
def grounding_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    share = grounding_share(F.col("text"), F.col("context"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 4).alias("share"), (share < 0.25).alias("warned"))


