"""Operators against golden values and plain-Python twins."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions import query as qx
from quarrystone.functions import text as tx
from quarrystone.operators import chat, chunking, context, dense, fusion, holding, lexical, reports, tables
from quarrystone.plans import rebuild, retrieval, retrieve
from quarrystone.sources import files
from quarrystone.sources.paged import SavedPages
from quarrystone.streaming import ingest


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_golden_texts(spark):
    assert one(spark, tx.lexical_tokens, "État-of  the-ART élé!") == ["étatof", "theart", "élé"]
    assert [one(spark, tx.layer_of, y, "int") for y in (None, 2019, 2020, 2024, 2025)] == ["core", "prerequisite", "foundation", "core", "latest"]
    assert one(spark, lambda y: tx.layer_of(y, F.lit(True)), 2022, "int") == "prerequisite"
    assert [one(spark, tx.era_of, y, "int") for y in (2016, 2017, 2020, 2021, 2023, 2024)] == ["pre_2017", "early_2017_2020", "early_2017_2020", "middle_2021_2023", "middle_2021_2023", "recent_2024_plus"]
    assert [one(spark, tx.normalize_published, s) for s in ("2024-05-06T01:02Z", "2024-05", "2024", "", "n/a")] == ["2024-05-06", "2024-05-01", "2024-01-01", None, None]
    assert {one(spark, tx.normalize_paper_id, s) for s in ("arxiv:2301.12345", "2301.12345v2", "https://arxiv.org/pdf/2301.12345v2.pdf")} == {"2301.12345"}
    assert one(spark, tx.uuid5, "2401.00001_text_0") == "70c5cae7-b1aa-5db6-8100-47ae382651a3"
    names = ["", "a", "é", "x" * 99]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(tx.uuid5(F.col("x"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    heads = {"method": "other", "3 Introduction": "other", "Discussion": "other", "Conclusion": "other", "results": "results", "related work": "related_work", "iv. results": "results", "evaluation": "experiments", "Our method": "method"}
    assert {h: one(spark, lambda c: tx.normalize_section(c, strict_compat=True), h) for h in heads} == heads
    assert [one(spark, tx.normalize_section, h) for h in ("method", "Introduction", "iv. results")] == ["method", "introduction", "results"]


def test_golden_bm25(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c d d d")], "doc_id long, text string")
    index = lexical.build(d)
    ask = lambda q: {r["doc_id"]: r["score"] for r in lexical.top(index, spark.createDataFrame([(0, q)], "qid long, text string"), 10).collect()}
    assert ask("a c") == {1: pytest.approx(0.7298, abs=1e-4)} and ask("a a") == {1: pytest.approx(1.4595, abs=1e-4)}
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["a"] == pytest.approx(0.510826, abs=1e-6) and idf["b"] == pytest.approx(0, abs=1e-12)
    assert index.consistent()


def test_golden_fusion(spark):
    of = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, rank int")
    for intent, dense_rows, lexical_rows, score in (("explanatory", [(0, 1, 1)], [(0, 1, 2)], 0.016314), ("discovery", [(0, 1, 1)], [(0, 1, 3)], 0.016081), ("discovery", [], [(0, 1, 1)], 0.009836)):
        i = spark.createDataFrame([(0, intent)], "qid long, intent string")
        assert fusion.fused(of(dense_rows), of(lexical_rows), i).first()["score"] == pytest.approx(score, abs=1e-6)
    rows = [(0, k, k, s, "evidence") for k, s in enumerate((0.9, 0.7, 0.62, 0.1), 1)]
    d = spark.createDataFrame(rows, "qid long, doc_id long, rank int, score double, intent string")
    assert [r["doc_id"] for r in fusion.above_threshold(d, F.col("intent")).orderBy("rank").collect()] == [1, 2]
    small = d.withColumn("score", F.col("rank") * -0.001 + 0.017)
    assert fusion.above_threshold(small, F.col("intent")).count() == 1


def test_golden_metrics(spark):
    found = spark.createDataFrame([(0, i, k) for k, i in enumerate((90, 1, 91, 2, 92), 1)], "qid long, doc_id long, rank int")
    relevant = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "qid long, doc_id long")
    r = reports.metrics(found, relevant, spark.createDataFrame([(0,)], "qid long"), (5,)).first()
    assert (r["ndcg_5"], r["recall_5"], r["precision_5"], r["mrr"]) == (0.498189, 0.666667, 0.4, 0.5)


def test_golden_percentiles_budget_windows(spark):
    d = spark.range(1, 21).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("g"))
    assert reports.latency(d, "x", "g").first()["p95_ms"] == 19.1 and reports.p95_by_index(d, "x", "g").first()["p95_ms"] == 20.0
    for n, dealt in ((4, "7666"), (6, "544444"), (7, "4444333"), (8, "43333333")):
        rows = spark.createDataFrame([(0, k, "A b. " * 30) for k in range(1, n + 1)], "qid long, rank int, text string")
        assert "".join(str(r["n_sentences"]) for r in context.packed(rows).orderBy("rank").collect()) == dealt
    d = spark.createDataFrame([(1, " ".join(map(str, range(1000))))], "k long, text string")
    got = [(r["chunk_text"].split()[0], r["token_count"]) for r in chunking.token_windows(d, "k", "text").orderBy("chunk_index").collect()]
    assert got == [("0", 450), ("383", 450), ("766", 234)]


def test_upsert(spark):
    schema = "paper_id string, title string, quality_score float, is_seed boolean, layer string"
    old, new = spark.createDataFrame([("p", "A", 0.9, True, "core")], schema), spark.createDataFrame([("p", "", 0.5, False, "latest"), ("q", "B", 0.1, False, "core")], schema)
    once = tables.upsert(old, new, "paper_id", tables.PAPER_RULES)
    rows = {r["paper_id"]: r for r in once.collect()}
    assert (rows["p"]["title"], round(rows["p"]["quality_score"], 3), rows["p"]["is_seed"], rows["p"]["layer"]) == ("A", 0.9, True, "latest") and len(rows) == 2
    again = tables.upsert(once, new, "paper_id", tables.PAPER_RULES)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(ValueError):
        tables.with_field(old, "paper_id", "p", "paper_id", "x")


def intent_twin(q):
    import re

    q = q.strip()
    for intent, phrases in config.INTENT_PHRASES:
        if re.search(qx.any_of(phrases), q):
            return intent
    return "explanatory" if q.endswith("?") and len(q.split()) <= 8 else "discovery"


ASKED = ("What is attention?", "transformers vs RNNs", "CNN vs. MLP results", "latest results 2025", "prove the theorem", "empirical evidence for superposition", "sparse autoencoders", "summarize this paper", "Summary", "", "Is it so?", "what is the difference between a and b")


def variants_twin(q):
    import re

    q = " ".join(q.split())
    if not q:
        return []
    intent = intent_twin(q)
    every = [q] + [f"{q} {w}" for w in config.VARIANT_SUFFIXES.get(intent, ())]
    if re.search(qx.any_of(config.SUMMARY_PHRASES), q):
        every += [f"{q} {w}" for w in config.SUMMARY_SUFFIXES] + ["main contributions"]
    if intent == "comparative" and " vs " in q.lower():
        every += [p.strip() for p in re.split(r"(?i)\bvs\.?\b|\bversus\b", q, maxsplit=1) if p.strip()]
    out = {}
    for v in every:
        out.setdefault(v.lower(), v)
    return list(out.values())[:5]


def test_questions(spark):
    d = spark.createDataFrame(list(enumerate(ASKED)), "i int, q string").withColumn("intent", qx.intent_of(F.col("q")))
    for r in d.withColumn("v", qx.variants_of(F.col("q"), F.col("intent"))).collect():
        assert r["intent"] == intent_twin(r["q"]) and r["v"] == variants_twin(r["q"])


def test_all_questions_of_the_tables_are_decomposed(spark):
    sf = "/root/testdata/sf0.001"
    asked = [("benchmark", r["item_id"], None, r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    asked += [("conversations", r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = sorted(repr(tuple(r[c] for c in ("source", "id", "turn", "place", "variant"))) for r in retrieval.query_decompose(spark, sf).collect())
    assert got == sorted(repr((*at, k, v)) for *at, text in asked for k, v in enumerate(variants_twin(text or "")))


def test_ablation_runs_every_variant(monkeypatch):
    asked = []
    monkeypatch.setattr(retrieval, "corpus_of", lambda spark, sf_dir: None)
    monkeypatch.setattr(retrieval, "questions", lambda spark, sf_dir: None)
    monkeypatch.setattr(retrieve, "ablation", lambda corpus, questions, names, **options: asked.extend(names))
    retrieval.ablation_variants(None, "")
    assert asked == ["dense_only", "bm25_only", "hybrid_rrf", "hybrid_reranker", "no_rerank", "no_mmr", "full"]


def mmr_twin(rel, vectors, k, trade):
    n = len(rel)
    if n <= k:
        return list(range(n))
    span = max(rel) - min(rel)
    rel = [(x - min(rel)) / span if span else 1.0 for x in rel]
    chosen = [0]
    while len(chosen) < k:
        rest = [i for i in range(n) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (round(trade * rel[i] - (1 - trade) * max(float(vectors[i] @ vectors[j]) for j in chosen), 9), -i)))
    return chosen


@given(st.integers(1, 12), st.integers(1, 8), st.integers(0, 10**6), st.sampled_from([0.5, 0.65, 0.8]))
@settings(max_examples=60, deadline=None)
def test_mmr(n, k, seed, trade):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = np.sort(rng.random(n))[::-1]
    got = fusion.mmr_order(rel, v, k, trade)
    assert got == mmr_twin(rel.tolist(), v, k, trade) and got[0] == 0 and len(set(got)) == len(got) == min(n, k)


def test_sections_and_packing():
    text = "Title words here.\n1 Introduction\nIt begins. It goes on.\n\n2. Methods\n" + "We do things well. " * 200 + "\nReferences\n[1] x"
    heads = [h for h, _, _ in chunking.sections(text)]
    assert heads[0] == "preface" and "1 Introduction" in heads and "2. Methods" in heads and heads[-1] == "References"
    chunks = chunking.section_chunks(text)
    assert all(n <= chunking.MOST for _, _, n in chunks)
    methods = [c for h, c, _ in chunks if h == "2. Methods"]
    assert len(methods) > 1 and all(n >= chunking.TAIL for h, _, n in chunks[1:])
    assert methods[1].startswith("We do things well. We do things well.")
    assert chunking.section_chunks("") == [] and chunking.section_chunks("short text") == [("unknown", "short text", 2)]


def test_per_paper_cap_and_dense_filter_never_leak(spark):
    rng = random.Random(1)
    rows = [(0, i, i + 1, 1.0 / (i + 1), "discovery", rng.choice(["p", "q", ""])) for i in range(40)]
    d = spark.createDataFrame(rows, "qid long, doc_id long, rank int, score double, intent string, paper_id string")
    got = fusion.capped(d).groupBy("paper_id").count().collect()
    assert all(r["count"] <= 4 for r in got if r["paper_id"])
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "vec_id long, embedding array<float>, g int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<float>")
    assert {r["vec_id"] % 2 for r in dense.top(v.where("g = 1"), q, 50).collect()} == {1}
    assert dense.top(v, q.limit(0), 5).count() == 0


def test_every_question_has_a_dense_arm(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (130, 4)).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"word{i} common") for i in range(90)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"word{i} other") for i in range(130)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.arms(spark, str(tmp_path))[0].collect()}
    dots = x[:90] @ x.T
    best = {q: sorted(range(130), key=lambda d: (-dots[q, d], d))[:60] for q in range(90)}
    assert got == {(q, k + 1): (d, dots[q, d]) for q, ds in best.items() for k, d in enumerate(ds)}


def test_mmr_is_asked_all_over(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(130, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval.mmr_select(spark, str(tmp_path)).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in got} == dict.fromkeys(range(0, 130, 20), 10)


def test_dense_top_asks_in_parts(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(50)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, i / 8]) for i in range(20)], "qid long, vector array<float>")
    whole = sorted(dense.top(v, q, 9).collect())
    monkeypatch.setattr(dense, "ASKED", 3)
    assert sorted(dense.top(v, q, 9).collect()) == whole and {r["qid"] for r in whole} == set(range(20))


def test_plans_keep_their_shape(spark):
    v = spark.createDataFrame([(i, "a b", "en") for i in range(5)], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(0, "a")], "qid long, text string")
    plan = lexical.top_then_filter(lexical.build(v), q, v.select("doc_id", "lang"), F.col("lang") == "en", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "x", "token_count": 3}\n\n  \n{"chunk_id": "y"}\n')
    d = files.read_jsonl(spark, str(tmp_path / "c.jsonl"), files.CHUNKS)
    assert [r["chunk_id"] for r in d.collect()] == ["x", "y"] and files.count_jsonl(spark, str(tmp_path / "c.jsonl")) == 2
    (tmp_path / "m.json").write_text('{"p1": {"title": "T", "published": "2024-05"}, "p2": "broken"}')
    assert [tuple(r)[:2] for r in files.read_papers_map(spark, str(tmp_path / "m.json")).collect()] == [("p1", "T")]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "2301.1.pdf").write_bytes(b"x" * 2000)
    (tmp_path / "pdf" / "small.pdf").write_bytes(b"x")
    assert [r["paper_id"] for r in files.read_documents(spark, str(tmp_path / "pdf")).collect()] == ["2301.1"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "0.json").write_text('[{"a": 1}, {"a": 2}]')
    spark.dataSource.register(SavedPages)
    assert spark.read.format("saved_pages").option("path", str(tmp_path / "pages")).load().count() == 2
    rec = spark.createDataFrame([('{"paperId":"s","externalIds":{"ArXiv":"2301.00001"},"title":"T","year":2023,"authors":[{"name":"A"},{"name":"B"}]}',)], "json string")
    assert files.from_citation_records(rec).first()["authors"] == "A, B"
    atom = spark.createDataFrame([('<entry><id>http://arxiv.org/abs/2301.00001v2</id><title>A\n B</title><summary>S</summary><published>2023-01-02T00:00Z</published><author><name>X</name></author><category term="cs.CL"/></entry>',)], "xml string")
    r = files.from_atom_entries(atom).first()
    assert (r["paper_id"], r["title"], r["published"], r["categories"]) == ("2301.00001", "A B", "2023-01-02", "cs.CL")


def test_rebuild_and_retrieve(spark, tmp_path):
    body = "1 Introduction\n" + "Attention heads copy tokens. " * 60 + "\n2 Results\n" + "Circuits explain induction well. " * 60
    rows = [(f"23{i:02d}.0000{i}", f"Paper {i}", "", "Ann, Bob", "cs.CL", "core", body.replace("Attention", f"Topic{i}")) for i in range(4)]
    p = spark.createDataFrame(rows, "paper_id string, title string, abstract string, authors string, categories string, layer string, full_text string").withColumn("published", F.to_date(F.lit("2024-01-01")))
    version = rebuild.rebuild(p, str(tmp_path / "snap"))
    corpus = rebuild.opened(spark, str(tmp_path / "snap"))
    assert files.manifest(spark, str(tmp_path / "snap"))["corpus_version"] == version
    q = spark.createDataFrame([(0, "What is Topic2?")], "qid long, text string")
    got = retrieve.retrieve(corpus, q, as_of="2025-01-01", top_n=3).orderBy("place").collect()
    assert got and got[0]["paper_id"] == "2302.00002"


def test_job_steps():
    state = "queued"
    seen = [state := ingest.step(state, "advance") for _ in range(5)]
    assert seen == ["downloading", "chunking", "embedding", "done", "done"]
    assert ingest.step("chunking", "cancel") == "cancelled" and ingest.step("cancelled", "advance") == "cancelled" and ingest.step("queued", "fail") == "failed"


def test_questions_in_passes_and_frames(spark, monkeypatch):
    """Passes over the questions and small batches of vectors change nothing."""
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(300)], "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id qid", "embedding vector")
    of = lambda: sorted(tuple(r) for r in dense.top(v, q, 7).collect())
    whole = of()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in v.collect()}
    for i in range(0, 300, 20):
        best = sorted((-round(float(x[i] @ x[j]), 6), j) for j in x)[:7]
        assert [(s, j) for qid, j, s, _ in sorted(whole, key=lambda r: r[3]) if qid == i] == [(-s, j) for s, j in best]
    monkeypatch.setattr(dense, "MOST_NUMBERS", 20)
    monkeypatch.setattr(dense, "BLOCK", 16)
    assert of() == whole


def test_quota_and_rolling_by_hand(spark):
    layers = ["latest"] * 5 + ["foundation"] * 2 + ["core"] * 6 + ["latest", "foundation"] * 6
    got = [r["paper_id"] for r in reports.quota(spark.createDataFrame(list(enumerate(layers)), "paper_id int, layer string")).orderBy("total").collect()]
    count, expected = {}, []
    for i, layer in enumerate(layers):
        n, total = count.get(layer, 0), max(1, sum(count.values()))
        if {"latest": 0.55, "core": 0.35}.get(layer, 1) >= 1 or n / total < {"latest": 0.55, "core": 0.35}[layer] or n % 3 == 0:
            count[layer] = n + 1
            expected.append(i)
    assert got == expected
    d = spark.range(500).selectExpr("id", "timestamp_seconds(id * 977) ts", "cast(id * 37 % 101 as double) value")
    out = {r["id"]: (r["rolling_avg"], r["rolling_max"]) for r in chat.rolling(d, "value", "ts", "id", rows=50, block=60).collect()}
    values = [i * 37 % 101 for i in range(500)]
    assert out == {i: (round(float(np.mean(values[max(0, i - 49) : i + 1])), 8), float(max(values[max(0, i - 49) : i + 1]))) for i in range(500)}


def test_holding_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a bc d"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "bc"), (8, ""), (9, None), (10, "bc"), (11, "zz")], "qid long, text string")
    assert sorted(tuple(r) for r in holding.holding(docs, items).collect()) == [(7, 1), (10, 1)]
    assert holding.holding(docs, items.limit(0)).count() == 0
    for _ in range(2):
        version = files.publish({"docs": docs}, str(tmp_path / "snap"))
        assert files.manifest(spark, str(tmp_path / "snap"))["corpus_version"] == version and files.snapshot(spark, str(tmp_path / "snap"), "docs").count() == 3
    index = lexical.of_snapshot(docs, str(tmp_path / "snap"))
    again = lexical.of_snapshot(docs, str(tmp_path / "snap"))
    assert index.postings.inputFiles() == again.postings.inputFiles() and again.consistent()
    files.write_by_year(docs.withColumn("year", F.lit(2020)), str(tmp_path / "years"))
    assert spark.read.parquet(str(tmp_path / "years")).count() == 3
    files.append_log(docs, str(tmp_path / "log"))
    files.append_log(docs, str(tmp_path / "log"))


def test_frames_of_jobs(spark):
    """A job's events in several frames and any order; final states stay."""
    events = [("a", k, "advance") for k in range(6)] + [("b", 5, "fail"), *[("b", k, "advance") for k in (9, 1, 7)]] + [("c", 2, "cancel"), ("c", 3, "fail")] + [("d", k, "advance") for k in range(3)]
    where = spark.conf.get("spark.checkpoint.dir") + "/jobs-in"
    spark.createDataFrame(events, "job_id string, seq long, event string").orderBy(F.desc("seq")).coalesce(1).write.parquet(where)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        d = ingest.stream_table(spark, where, spark.read.parquet(where).schema)
        got = {r["job_id"]: r["state"] for r in ingest.collected(lambda: ingest.job_states(d), "update", "job_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": "done", "b": "failed", "c": "cancelled", "d": "embedding"}


def test_context_sizes(spark):
    """Each intent's number of passages, least with a query's, greatest with a chat's."""
    sizes = {config.EXPLANATORY: 6, config.TECHNICAL: 4, config.EVIDENCE: 4, config.COMPARATIVE: 6, config.SOTA: 8, config.DISCOVERY: 10}
    d = spark.createDataFrame([(i,) for i in sizes], "intent string")
    got = d.select("intent", fusion.context_size(F.col("intent"), 5), fusion.context_size(F.col("intent"), 5, chat=True)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (min(5, n), max(5, n)) for i, n in sizes.items()}
    pool = spark.createDataFrame([(q, k, "core" if k < 9 else "foundation", i) for q, i in enumerate(sizes) for k in range(1, 12)], "qid int, rank int, layer string, intent string")
    kept = fusion.with_foundation(pool, fusion.context_size(F.col("intent"), 5)).groupBy("intent").agg(F.sort_array(F.collect_list("rank"))).collect()
    assert {r[0]: r[1] for r in kept} == {i: [*range(1, min(5, n)), 9] for i, n in sizes.items()}
