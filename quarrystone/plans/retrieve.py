"""The whole way from questions to cited passages, as one plan over a batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions import prompts
from quarrystone.functions.query import gate_of, intent_of, is_summary, unlike, variants_of
from quarrystone.functions.text import lexical_tokens
from quarrystone.operators import dense, fusion, lexical
from quarrystone.sources.shared import few, stored

#: Dimensions of the default encoding.
DIMENSIONS = 64
# Papers whose chunks are looked at; chunks that give phrases, and the intents that ask
# for them; variants of a question; how many times what a reranker keeps it reads.
PARENTS, NEARBY, MOST_VARIANTS, RERANK_POOL = 20, 8, 8, 8
NEARBY_INTENTS = (config.COMPARATIVE, config.TECHNICAL, config.SOTA)


@dataclass(frozen=True)
class Corpus:
    """chunks: doc_id, paper_id, title, authors, categories, published (date), layer, section, text.
    vectors: doc_id, embedding.  edges: source, target, or none.  parents: the papers' own vectors
    (paper_id, vector), or none."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.Index
    edges: DataFrame | None = None
    parents: DataFrame | None = None


@dataclass(frozen=True)
class Flags:
    """What a run leaves out; ``expand`` off asks the question alone, without phrases of nearby
    chunks either; ``parents`` are the best papers' best chunks."""

    dense: bool = True
    lexical: bool = True
    parents: bool = True
    expand: bool = True
    nearby: bool = True
    boosts: bool = True
    rerank: bool = True
    mmr: bool = True
    threshold: bool = True


#: Runs to compare: those before the last three ask the question alone.
ABLATIONS = {
    "dense_only": Flags(lexical=False, expand=False, boosts=False, rerank=False, mmr=False, threshold=False),
    "bm25_only": Flags(dense=False, parents=False, expand=False, boosts=False, rerank=False, mmr=False, threshold=False),
    "hybrid_rrf": Flags(expand=False, boosts=False, rerank=False, mmr=False, threshold=False),
    "hybrid_reranker": Flags(expand=False, boosts=False, mmr=False, threshold=False),
    "no_rerank": Flags(rerank=False),
    "no_mmr": Flags(mmr=False),
    "full": Flags(),
}


@dataclass(frozen=True)
class Filters:
    """Hold for the dense arm before ranking, for the lexical arm after it."""

    category: str | None = None
    author: str | None = None
    start_year: int | None = None
    paper_id: str | None = None

    def of(self, with_paper: bool = True) -> Column:
        out = F.lit(True)
        for name, value in (("categories", self.category), ("authors", self.author)):
            if value:
                out = out & F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(value.lower()))
        if self.start_year:
            out = out & F.coalesce(F.year("published") >= self.start_year, F.lit(False))
        if self.paper_id is not None and with_paper:
            out = out & (F.col("paper_id").cast("string") == self.paper_id)
        return out


def encoded(d: DataFrame, text: str = "text", name: str = "vector", dimensions: int = DIMENSIONS) -> DataFrame:
    """The default encoding: signed feature hashing of terms, of length one.  A model takes its place."""

    @F.pandas_udf("array<float>")
    def sums(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, np.int64)
            v = np.bincount(h % dimensions, np.where(h >> 32 & 1, -1.0, 1.0), dimensions) if len(h) else np.zeros(dimensions)
            out.append((v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32))
        return pd.Series(out)

    return d.withColumn(name, sums(F.transform(lexical_tokens(F.col(text)), lambda t: F.xxhash64(t))))


#: A reranker: (candidates, questions, corpus) to (qid, doc_id, rerank).
Scorer = Callable[[DataFrame, DataFrame, Corpus], DataFrame]


def coverage(candidates: DataFrame, questions: DataFrame, corpus: Corpus) -> DataFrame:
    """The default reranker: (qid, doc_id, rerank), the share of the question's weight of
    terms that the chunk holds, in [0, 1]."""
    index = corpus.index
    terms = lexical.question_terms(questions).select("qid", "term").join(index.terms.select("term", F.greatest("idf", F.lit(0.0)).alias("w")), "term")
    terms = stored(terms, "terms")
    whole = terms.groupBy("qid").agg(F.sum("w").alias("whole"))
    if index.words is None:
        held = candidates.select("qid", "doc_id").join(terms, "qid").join(index.postings.select("term", "doc_id"), ["term", "doc_id"])
    else:
        held = index.words.select("doc_id", "terms").join(few(candidates.select("qid", "doc_id").distinct(), "pairs"), "doc_id")
        held = held.select("qid", "doc_id", F.explode("terms").alias("term")).join(F.broadcast(terms), ["qid", "term"])
    held = held.groupBy("qid", "doc_id").agg(F.sum("w").alias("held"))
    d = candidates.select("qid", "doc_id").join(held, ["qid", "doc_id"], "left").join(whole, "qid", "left")
    return d.select("qid", "doc_id", F.round(F.coalesce(F.when(F.col("whole") > 0, F.col("held") / F.col("whole")), F.lit(0.0)), 6).alias("rerank"))


def shared_words(question: Column, passage: Column) -> Column:
    """The share of the question's different terms that the passage holds."""
    asked = F.array_distinct(lexical_tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, lexical_tokens(passage))), F.size(asked)), F.lit(0.0))


def by_text(score: Callable[[Column, Column], Column] = shared_words) -> Scorer:
    """A reranker that reads question and passage, as a cross-encoder does: ``score`` is an
    expression of both, a pandas UDF too.  A passage is the chunk's contextual text where there is
    one; explanatory questions read the title before it."""

    def scorer(candidates: DataFrame, questions: DataFrame, corpus: Corpus) -> DataFrame:
        text = "contextual_text" if "contextual_text" in corpus.chunks.columns else "text"
        d = candidates.select("qid", "doc_id", "intent", "title").join(corpus.chunks.select("doc_id", F.col(text).alias("__text")), "doc_id", "left")
        d = d.join(questions.select("qid", F.col("text").alias("__question")), "qid")
        body = F.coalesce("__text", F.lit(""))
        titled = (F.col("intent") == config.EXPLANATORY) & (F.coalesce("title", F.lit("")) != "")
        passage = F.when(titled, F.concat("title", F.lit(" — "), body)).otherwise(body)
        return d.select("qid", "doc_id", F.round(F.coalesce(score(F.col("__question"), passage), F.lit(0.0)), 6).alias("rerank"))

    return scorer


def phrased(corpus: Corpus, understood: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, nearby): variants with phrases of the nearest chunks, of the questions whose intent
    and gates allow them."""
    on = understood.where(F.col("intent").isin(*NEARBY_INTENTS) & ~F.col("restrict_embedding_expansion")).select("qid", "text")
    found = dense.top(corpus.vectors, encode(on).select("qid", "vector"), NEARBY, key="doc_id")
    texts = few(found, "near").join(corpus.chunks.select("doc_id", F.substring("text", 1, 1200).alias("t")), "doc_id")
    texts = texts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("near"))
    return on.join(texts, "qid").select("qid", prompts.nearby_phrases(F.transform("near", lambda x: x["t"]), F.col("text")).alias("nearby"))


def within_parents(parents: DataFrame, vectors: DataFrame, questions: DataFrame, most: int, *, parent: str = "paper_id", key: str = "doc_id", each: int = 10) -> DataFrame:
    """(qid, parent, key, score): the ``each`` best chunks of a question's ``most`` best parents;
    both scores multiply.  ``parents`` (parent, vector), ``vectors`` (parent, key, embedding);
    parents meet by a hash, and by themselves at last."""
    hashed = lambda d: d.withColumn("__p", F.xxhash64(F.col(parent).cast("string")))
    best = dense.top(hashed(parents), questions, most, key="__p", vector="vector").select("qid", "__p", F.col("score").alias("__parent"))
    best = stored(best, "parents")
    kids = dense.top_within(hashed(vectors), best.join(questions, "qid"), each, group="__p", key=key)
    least = lambda c: F.greatest(F.lit(1e-6), F.col(c))
    kids = kids.join(best, ["qid", "__p"]).join(hashed(parents).select("__p", parent), "__p")
    return kids.select("qid", parent, key, F.round(least("__parent") * least("score"), 6).alias("score"))


def understood(questions: DataFrame, expand: bool = True, scoped: bool = False, near: Callable[[DataFrame], DataFrame] | None = None, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, intent, summary, gates) and (qid, v, text) of the questions' variants: of their own
    words, then those ``near`` gives (qid, nearby), then those that a model listed in ``answers``
    (qid, answer); eight at most."""
    q = questions.withColumn("intent", intent_of(F.col("text"))).withColumn("summary", is_summary(F.col("text")))
    q = q.select("*", *[c.alias(n) for n, c in gate_of(F.col("text"), F.col("intent")).items()])
    every = variants_of(F.col("text"), F.col("intent"), scoped)
    every = F.when(F.lit(not expand) | F.col("restrict_decompose"), F.slice(every, 1, 1)).otherwise(every)
    v = q
    if expand and near is not None:
        v = v.join(near(q), "qid", "left")
        every = F.concat(every, F.coalesce("nearby", F.array().cast("array<string>")))
    if expand and answers is not None:
        v = v.join(answers.select("qid", "answer"), "qid", "left")
        listed = F.when(~F.col("restrict_llm_expansion"), prompts.numbered_lines(F.col("answer"), F.col("text")))
        every = F.concat(every, F.coalesce(listed, F.array().cast("array<string>")))
    return q, v.select("qid", F.posexplode(unlike(every, MOST_VARIANTS)).alias("v", "text"))


def candidates(corpus: Corpus, questions: DataFrame, flags: Flags = Flags(), filters: Filters = Filters(), encode: Callable[[DataFrame], DataFrame] = encoded, answers: DataFrame | None = None, auxiliary: DataFrame | None = None) -> DataFrame:
    """Both arms, fused, ranked: qid, doc_id, score, rank, intent, the arms' ranks.  ``auxiliary``
    (qid, text) are further texts that only the dense arm asks, such as a made-up answer."""
    scoped = filters.paper_id is not None
    near = (lambda q: phrased(corpus, q, encode)) if flags.nearby else None
    q, v = understood(questions, flags.expand, scoped, near, answers)
    if near and flags.expand or answers is not None:
        v = stored(v, "variants")
    most_dense, most_lexical = max(b.k_dense for b in config.BUDGETS.values()), max(b.k_lexical for b in config.BUDGETS.values())
    intents = q.select("qid", "intent", "summary")
    none = intents.where(F.lit(False)).select("qid", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    den = lex = none
    if flags.dense:
        keep = corpus.chunks.where(filters.of()).select("doc_id")
        vectors = corpus.vectors.join(keep, "doc_id", "left_semi") if filters != Filters() else corpus.vectors
        asked = v if auxiliary is None else v.unionByName(auxiliary.where("trim(text) <> ''").select("qid", F.lit(-1).alias("v"), "text"))
        keyed = encode(asked).withColumn("qid", F.struct("qid", "v")).select("qid", "vector")
        ids = keyed.withColumn("k", F.xxhash64("qid.qid", "qid.v"))
        found = dense.top(vectors, ids.select(F.col("k").alias("qid"), "vector"), most_dense, key="doc_id")
        found = found.join(F.broadcast(ids.select(F.col("k").alias("qid"), F.col("qid.qid").alias("of"))), "qid").drop("qid").withColumnRenamed("of", "qid")
        found = found.join(F.broadcast(intents), "qid").where(F.col("rank") <= fusion.by_intent(F.col("intent"), "k_dense"))
        den = dense.best_variant(found.select("qid", "doc_id", "score"), "doc_id", 3 * most_dense)
    if flags.parents and corpus.parents is not None and not scoped:
        chunks = corpus.chunks.where(filters.of()).select("doc_id", "paper_id").where("paper_id is not null")
        papers = corpus.parents.join(chunks.select("paper_id").distinct(), "paper_id", "left_semi") if filters != Filters() else corpus.parents
        kids = within_parents(papers, corpus.vectors.join(chunks, "doc_id"), encode(questions).select("qid", "vector"), PARENTS).select("qid", "doc_id", "score")
        if flags.dense:  # a question without a dense hit of its own has none of its parents either
            kids = kids.join(den.select("qid").distinct(), "qid", "left_semi").unionByName(den.select("qid", "doc_id", "score"))
        most = F.greatest(5 * fusion.by_intent(F.col("intent"), "k_dense"), F.lit(200))
        den = dense.best_variant(kids, "doc_id", 5 * max(most_dense, 40)).join(intents, "qid").where(F.col("rank") <= most).select("qid", "doc_id", "score", "rank")
    if flags.lexical:
        five = lexical.best(corpus.index, lexical.question_terms(v, "qid", "text", "v"), 5 * most_lexical, "v").join(F.broadcast(intents), "qid")
        five = five.where(F.col("rank") <= 5 * fusion.by_intent(F.col("intent"), "k_lexical"))
        if filters != Filters():
            five = five.join(corpus.chunks.where(filters.of()).select("doc_id"), "doc_id", "left_semi")
        lex = lexical.ranked(five.drop("rank"), ["qid"], min(3 * most_lexical, 10_000))
    return fusion.fused(den, lex, intents)


def retrieve(corpus: Corpus, questions: DataFrame, *, as_of: str, top_n: int = 10, context: str | None = None, flags: Flags = Flags(), filters: Filters = Filters(), encode: Callable[[DataFrame], DataFrame] = encoded, scorer: Scorer = coverage, answers: DataFrame | None = None, auxiliary: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """qid, place, doc_id, paper_id, title, section, layer, score, intent of the passages: ``top_n``
    of a question, or with ``context`` (query or chat) as many as its intent takes, within that
    or from that on.  Candidates that the chunks don't have stay, without a paper or a text;
    ``found`` are candidates made before, by the same corpus, questions and flags."""
    scoped = filters.paper_id is not None
    wanted = F.lit(top_n) if context is None else fusion.context_size(F.col("intent"), top_n, context == "chat")
    most = max(top_n, *(b.context for b in config.BUDGETS.values())) if context == "chat" else top_n
    if found is None:
        found = stored(candidates(corpus, questions, flags, filters, encode, answers, auxiliary), "candidates")
    chunks = corpus.chunks.join(few(found.select("doc_id").distinct(), "asked"), "doc_id", "left_semi")
    d = found.join(chunks, "doc_id", "left").fillna({"title": "", "section": "other", "layer": "core", "text": ""})
    if flags.boosts:
        if corpus.edges is not None and not scoped:
            d = fusion.boosted_citations(d, corpus.edges)
        d = fusion.boosted_summary(d, F.col("summary")) if scoped else fusion.boosted_latest(d)
        d = fusion.reranked(d)
    if filters.start_year and not scoped:
        d = fusion.after_year(d, filters.start_year, F.lit(True))
    d = fusion.reranked(fusion.pruned(d)) if flags.boosts else d
    d = fusion.reranked(fusion.capped(d, 6 if scoped else config.PAPER_CAP))
    d = stored(d.drop("text"), "pool")  # a few rows a question from here on
    cap = F.greatest(2 * wanted, fusion.by_intent(F.col("intent"), "reranked") + 8)
    if flags.rerank:
        pool = d.where(F.col("rank") <= RERANK_POOL * cap)
        d = fusion.reranked(pool.join(scorer(pool, questions, corpus), ["qid", "doc_id"]).withColumn("score", F.col("rerank")))
    d = d.where(F.col("rank") <= cap)
    if flags.boosts:
        factor = fusion.section_factor(F.col("section"), F.col("intent")) * fusion.recency_factor(F.col("published"), F.col("intent"), as_of)
        d = d.withColumn("score", F.round(F.col("score") * factor, 6))
    d = stored(fusion.reranked(d), "scored")
    if flags.mmr:
        order = fusion.mmr(d, corpus.vectors, most)
        d = d.join(order, ["qid", "doc_id"], "left").withColumn("at", F.coalesce("position", F.col("rank") + F.lit(10**6)))
        d = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).drop("at", "position")
    d = fusion.with_foundation(d, wanted)
    if flags.threshold and flags.rerank:
        d = fusion.above_threshold(d, F.col("intent"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return d.select("qid", place.alias("place"), "doc_id", "paper_id", "title", "section", "layer", "score", "intent")


def ablation(corpus: Corpus, questions: DataFrame, names: list[str], **options) -> DataFrame:
    """The passages of several runs, one below the other, with the run's name.  Runs whose flags for
    candidates are the same share these."""
    out, made = None, {}
    given = {k: options[k] for k in ("filters", "encode", "answers", "auxiliary") if k in options}
    for name in names:
        f = ABLATIONS[name]
        arms = (f.dense, f.lexical, f.parents, f.expand, f.nearby)
        if arms not in made:
            made[arms] = stored(candidates(corpus, questions, f, **given), "candidates")
        d = retrieve(corpus, questions, flags=f, found=made[arms], **options).withColumn("variant", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out
