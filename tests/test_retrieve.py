"""The retrieval plan's arms, expansions and reranking, each by hand or against a twin."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions.text import paper_text
from quarrystone.operators import dense, lexical
from quarrystone.plans import growth, rebuild, retrieval, retrieve
from quarrystone.sources.shared import kept

SF = "/root/testdata/sf0.001"
WORDS = ("alpha", "beta", "gamma", "delta")


def encode(d, text="text", name="vector"):
    """One number for each word that a text holds."""
    return d.withColumn(name, F.array(*[F.contains(F.lower(text), F.lit(w)).cast("float") for w in WORDS]))


def test_best_within_groups(spark, monkeypatch):
    """A group with half of all vectors, groups nobody asks for, nulls, ties; in one pass and many."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 41 == 0 else i % 2 and 7 or i % 9, None if i % 37 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, g long, embedding array<float>").repartition(5)
    asked = [(q, g, rng.integers(-2, 3, 3).astype(float).tolist()) for q in range(6) for g in (7, q, 100)]
    asked = [*{(q, g): (q, g, x) for q, g, x in asked}.values(), (9, None, [1.0, 0.0, 0.0]), (10, 7, None)]
    q = spark.createDataFrame(asked, "qid long, g long, vector array<float>")
    want = set()
    for qid, g, x in asked:
        if g is not None and x is not None:
            near = sorted((-float(np.dot(x, e)), i) for i, at, e in rows if at == g and e is not None)[:5]
            want |= {(qid, g, i, -s, k + 1) for k, (s, i) in enumerate(near)}
    of = lambda: {(r["qid"], r["g"], r["vec_id"], r["score"], r["rank"]) for r in dense.top_within(v, q, 5, group="g").collect()}
    assert of() == want and len(want) == 60
    monkeypatch.setattr(dense, "BLOCK", 16)
    monkeypatch.setattr(dense, "ASKED", 4)
    monkeypatch.setattr(dense, "MOST_NUMBERS", 12)
    assert of() == want
    assert not dense.top_within(v, q.where("false"), 5, group="g").count() and not dense.top_within(v.where("false"), q, 5, group="g").count()


def test_centroids_by_hand(spark):
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("a", None), ("z", [0.0, 0.0])], "g string, embedding array<float>")
    got = {r["g"]: r["vector"] for r in dense.centroids(v, "g").collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0]


@pytest.fixture
def corpus(spark, monkeypatch):
    """Two chunks for each arm, so that every further way shows."""
    small = {i: replace(b, k_dense=2, k_lexical=1) for i, b in config.BUDGETS.items()}
    monkeypatch.setattr(config, "BUDGETS", small)
    rows = [(1, "A", "alpha first"), (2, "A", "alpha again. Sparse coding trick. alpha"), (3, "B", "beta and gamma"), (4, "B", "beta"), (5, "C", "about a coding trick of old"), (6, "C", "zeta zeta"), (7, "D", "delta"), (8, None, "nothing")]
    rows += [(i, "E", f"filler number{i}") for i in range(20, 40)]
    d = spark.createDataFrame(rows, "doc_id long, paper_id string, text string")
    chunks = d.select("doc_id", "paper_id", F.lit("T").alias("title"), F.lit("x").alias("authors"), F.lit("cs").alias("categories"), F.to_date(F.lit("2024-01-01")).alias("published"), F.lit("core").alias("layer"), F.lit("method").alias("section"), "text")
    vectors = encode(d, name="embedding").select("doc_id", "embedding")
    parents = spark.createDataFrame([("A", [0.1, 0.0, 0.0, 0.0]), ("B", [0.9, 0.0, 0.0, 0.0]), ("D", None)], "paper_id string, vector array<float>")
    return retrieve.Corpus(chunks, vectors, lexical.build(d, "doc_id", "text"), parents=parents)


def found(corpus, text, **options):
    q = corpus.chunks.sparkSession.createDataFrame([(5, text)], "qid long, text string")
    return {r["doc_id"]: r for r in retrieve.candidates(corpus, q, encode=encode, **options).collect()}


def test_each_way_adds_its_rows(corpus):
    asked, alone = "latest alpha progress", retrieve.Flags(parents=False, nearby=False)
    spark = corpus.chunks.sparkSession
    base = found(corpus, asked, flags=alone)
    assert {1, 2} <= set(base) and not {3, 4, 5, 6, 7} & set(base)
    with_parents = found(corpus, asked, flags=replace(alone, parents=True))
    assert {3, 4} <= set(with_parents) and with_parents[3]["dense_rank"] > base[1]["dense_rank"]
    # within one paper there is no such way, nor where a filter leaves the paper nothing
    assert not {3, 4} & set(found(corpus, asked, flags=replace(alone, parents=True), filters=retrieve.Filters(paper_id="A")))
    assert not set(found(corpus, asked, flags=replace(alone, parents=True), filters=retrieve.Filters(author="nobody")))
    assert {3, 4} <= set(found(corpus, asked, flags=replace(alone, parents=True, dense=False)))
    assert 5 in found(corpus, asked, flags=replace(alone, nearby=True)) and 5 not in found(corpus, "what is alpha?", flags=replace(alone, nearby=True))
    answers = spark.createDataFrame([(5, "Sure:\n1. what is zeta\n2. Latest alpha progress")], "qid long, answer string")
    assert 6 in found(corpus, asked, flags=alone, answers=answers) and 6 not in found(corpus, asked, flags=replace(alone, expand=False), answers=answers)
    auxiliary = spark.createDataFrame([(5, "perhaps delta"), (5, " ")], "qid long, text string")
    more = found(corpus, asked, flags=alone, auxiliary=auxiliary)
    assert more[7]["dense_rank"] and more[7]["lexical_rank"] is None


def test_parents_against_a_twin(corpus, spark):
    asked = [(1, "alpha beta"), (2, "gamma"), (3, "delta")]
    q = encode(spark.createDataFrame(asked, "qid long, text string")).select("qid", "vector")
    v = corpus.vectors.join(corpus.chunks.select("doc_id", "paper_id"), "doc_id")
    got = {(r["qid"], r["paper_id"], r["doc_id"], r["score"]) for r in retrieve.within_parents(corpus.parents, v, q, 1, each=2).collect()}
    want = set()
    chunks = [(r["paper_id"], r["doc_id"], r["embedding"]) for r in v.collect()]
    papers = [(r["paper_id"], r["vector"]) for r in corpus.parents.collect() if r["vector"]]
    hashes = {r["paper_id"]: r["h"] for r in corpus.parents.select("paper_id", F.xxhash64("paper_id").alias("h")).collect()}
    for r in q.collect():
        s, _, p = min((-round(float(np.dot(x, r["vector"])), 6), hashes[p], p) for p, x in papers)
        kids = sorted((-float(np.dot(e, r["vector"])), i) for at, i, e in chunks if at == p)[:2]
        want |= {(r["qid"], p, i, round(max(1e-6, -s) * max(1e-6, -own), 6)) for own, i in kids}
    assert got == want


def test_rerankers_read_texts(spark, corpus):
    pool = spark.createDataFrame([(0, 1, "explanatory", "Alpha paper"), (0, 3, "explanatory", ""), (1, 1, "discovery", "Alpha paper"), (1, 99, "discovery", None)], "qid long, doc_id long, intent string, title string")
    q = spark.createDataFrame([(0, "paper first gamma"), (1, "paper first")], "qid long, text string")
    seen = {(r["qid"], r["doc_id"]): r["rerank"] for r in retrieve.by_text()(pool, q, corpus).collect()}
    assert seen == {(0, 1): 0.666667, (0, 3): 0.333333, (1, 1): 0.5, (1, 99): 0.0}
    asked = spark.createDataFrame([(0, "alpha filler")], "qid long, text string")
    rows = retrieve.retrieve(corpus, asked, as_of="2025-01-01", top_n=3, encode=encode, scorer=retrieve.by_text(lambda question, passage: F.length(passage) / 100)).collect()
    assert len(rows) == 3 and {r["qid"] for r in rows} == {0}


def test_reranker_reads_eight_times_what_it_keeps(spark, corpus, monkeypatch):
    """The best chunk comes last by fusion, beyond what is kept and within what is read."""
    monkeypatch.setattr(config, "BUDGETS", {i: replace(b, k_dense=2, k_lexical=40, reranked=-6) for i, b in config.BUDGETS.items()})
    asked = spark.createDataFrame([(0, "alpha filler")], "qid long, text string")
    flags = retrieve.Flags(parents=False, nearby=False, expand=False, boosts=False, mmr=False, threshold=False)
    ranked = [r["doc_id"] for r in retrieve.candidates(corpus, asked, flags, encode=encode).orderBy("rank").collect()]
    kept, last = 2, ranked[5]

    def scorer(pool, questions, corpus):
        return pool.select("qid", "doc_id", F.when(F.col("doc_id") == last, 1.0).otherwise(0.5).alias("rerank"))

    got = retrieve.retrieve(corpus, asked, as_of="2025-01-01", top_n=1, flags=flags, encode=encode, scorer=scorer).collect()
    assert len(ranked) > 8 * kept and last not in ranked[:kept] and got[0]["doc_id"] == last


def test_papers_own_vectors(spark):
    assert spark.range(1).select(paper_text(F.lit(" A  b "), F.lit("c")), paper_text(F.lit(None), F.lit("c")), paper_text(F.lit("t"), F.lit("x" * 20_000))).first()[:2] == ("Title: A b\n\nAbstract: c", "c")
    p = spark.createDataFrame([("p", "Alpha", ""), ("q", "", "gamma"), ("r", None, None)], "paper_id string, title string, abstract string")
    c = spark.createDataFrame([("p", 1, "abstract", "delta"), ("p", 0, "abstract", "beta"), ("p", 2, "method", "gamma")], "paper_id string, chunk_index int, section string, chunk_text string")
    assert {r["paper_id"]: r["vector"] for r in rebuild.parents_of(p, c, encode).collect()} == {"p": [1.0, 1.0, 0.0, 1.0], "q": [0.0, 0.0, 1.0, 0.0]}


def test_nearby_phrases_against_a_twin(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        if r["text"] is None or r["item_id"] not in vectors:
            continue
        x = vectors[r["item_id"]]
        near = [i for _, i in sorted((-round(float(x @ y), 6), i) for i, y in vectors.items())[:8] if i in texts]
        phrases = [p for i in near for p in re.findall(r"\b[A-Z][a-z]+(?:\s+[a-z]{2,}){0,3}\b", (texts[i] or "")[:1200]) if len(p) > 5 and p.lower() not in r["text"].lower()]
        want |= {(r["item_id"], k, f"{r['text']} {p}") for k, p in enumerate(sorted(list(dict.fromkeys(phrases))[:12])[:4])}
    got = {tuple(r) for r in growth.embedding_expansion(spark, SF).collect()}
    assert got == want and want


def test_vectors_are_encoded_once_for_a_version(spark, tmp_path, monkeypatch):
    at, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.read.parquet(at).selectExpr("id + 1 as x")

    spark.range(3).write.parquet(at)
    of = lambda: sorted(r["x"] for r in kept(spark, at, "plus-one", make).collect())
    assert of() == of() == [1, 2, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(at)
    assert of() == [1, 2, 3, 4, 5] and len(made) == 2
    first = retrieval.corpus_of(spark, SF)
    monkeypatch.setattr(retrieve, "encoded", None)
    again = retrieval.corpus_of(spark, SF)
    assert again.vectors.inputFiles() == first.vectors.inputFiles() and again.parents.count() == first.chunks.select("paper_id").distinct().count()
