"""What shows on larger tables only: ids of six digits, each task's best, shared work."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions.text import is_relevant, lexical_tokens
from quarrystone.operators import frontier, lexical, pruned
from quarrystone.plans import corpus, growth, retrieval  # noqa: F401 - registers the queries
from quarrystone.plans.base import ORACLES, QUERIES

IDS = [*range(0, 40), *range(99_990, 100_040), *range(1_234_560, 1_234_600)]


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """Documents whose ids reach beyond 99,999."""
    root = tmp_path_factory.mktemp("numbered")
    d = spark.createDataFrame([(i, f"words of {i} " * 30, "en", f"src{i % 3}", 300) for i in IDS], "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(1).write.parquet(str(root / "documents.parquet"))
    return str(root)


def both(spark, root, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet/*.parquet')")
    return sorted(tuple(r) for r in QUERIES[name](spark, root).collect()), sorted(con.execute(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["keyword_admission", "missing_text_queue"])
def test_ids_beyond_five_digits(spark, numbered, name):
    got, wanted = both(spark, numbered, name)
    assert got == wanted and any(len(r[0]) > 10 for r in got)


def test_gates_read_texts_once(spark, tmp_path, monkeypatch):
    """Two rounds ask for the gate of a link once, and no decision shuffles an abstract."""
    calls = []
    plain = frontier.gated
    monkeypatch.setattr(frontier, "gated", lambda links: calls.append(1) or plain(links))
    word = "transformer"
    papers = spark.createDataFrame([(f"p{i}", "t", "a", "core", True) for i in range(1)], "paper_id string, title string, abstract string, layer string, is_seed boolean")
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}", "reference", f"{word} {i}", f"abstract {i}", 2018, i) for i in range(9)] + [("p0", "px", "reference", "off", "off", 2018, 3)], "source string, paper_id string, direction string, title string, abstract string, year int, place long")
    got = frontier.expand(papers, spark.createDataFrame([], "source string, target string, direction string"), links, f"{tmp_path}/x", rounds=4)
    rows = {r["paper_id"]: r["abstract"] for r in got["papers"].collect()}
    assert len(calls) == 1 and rows == {"p0": "a"} | {f"p{i}": f"abstract {i - 1}" for i in range(1, 5)}


@pytest.mark.parametrize("text", ["Self-Attention MECHANISM", "a transformers b", "neural  circuits", "", None])
def test_relevance_is_the_pattern_of_all_words(spark, text):
    d = spark.createDataFrame([(text, "x"), ("x", text)], "t string, a string")
    pattern = F.lower(F.concat_ws(" ", F.coalesce("t", F.lit("")), F.coalesce("a", F.lit("")))).rlike("|".join(config.RELEVANT))
    assert all(r[0] == r[1] for r in d.select(is_relevant(F.col("t"), F.col("a")), pattern).collect())


@pytest.mark.parametrize("bounds", [{}, {"MOST_KEPT": 12, "SUMMED": 40, "COUNTED": 3}])
def test_best_in_tasks_is_the_join(spark, monkeypatch, bounds):
    """Copies that tie, variants, unknown words, terms in most documents, passes and small blocks."""
    for k, v in bounds.items():
        monkeypatch.setattr(lexical, k, v)
    d = spark.createDataFrame([(i, f"the common w{i % 7} w{i % 11} {'the ' * (i % 4)}") for i in range(80)] + [(100, None), (101, "")], "doc_id long, text string").repartition(3)
    index = lexical.build(d)
    q = spark.createDataFrame([(i, v, f"the w{i} w{i + v} w{i} unknown") for i in range(9) for v in range(2)] + [(20, 0, "nothing here")], "qid long, v int, text string")
    terms = lexical.question_terms(q, "qid", "text", "v")
    joined = lexical.scores(index, terms, ["qid", "v"]).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    wanted = sorted(lexical.ranked(joined.where("score > 0"), ["qid"], 5).select("qid", "doc_id", "score", "rank").collect())
    got = lexical.best(index, terms, 5, "v")
    assert sorted(got.select("qid", "doc_id", "score", "rank").collect()) == wanted and len(wanted) >= 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no pair of a question and a document is a row


def test_repeated_ids_are_joined(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "b")], "doc_id long, text string")
    index = lexical.build(d)
    assert index.words is None and {(r["doc_id"], r["term"], r["tf"]) for r in index.postings.collect()} == {(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "b", 1)}
    q = spark.createDataFrame([(0, "c")], "qid long, text string")
    assert [r["doc_id"] for r in lexical.top(index, q, 3).collect()] == [1]


def test_pruned_reads_little_of_terms_that_most_documents_have(spark, tmp_path):
    """The threshold is a whole score: what each document has doesn't keep its blocks in."""
    d = spark.createDataFrame([(i, f"the of {'rare words here ' if i % 50 == 0 else ''}{' '.join(f'x{i * j % 97}' for j in range(1, 9))}") for i in range(1000)], "doc_id long, text string")
    index = lexical.build(d)
    q = spark.createDataFrame([(0, "the of rare words here")], "qid long, text string")
    rows, read, _ = pruned.weighed(pruned.build(index, f"{tmp_path}/b", block=16), index, q, 5)
    key = lambda r: (r["qid"], r["doc_id"], r["score"], r["rank"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, lexical.top(index, q, 5).collect()))
    assert (read.agg(F.sum("size")).first()[0] or 0) <= 100


def test_words_are_split_at_the_white_space_of_tokens(spark):
    """Arrow splits where documents are read, and Spark makes no array of words before; every other space stays in a word."""
    ends = [chr(c) for c in (*range(0, 48), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF)]
    d = spark.createDataFrame([*enumerate(f"{a}Ab{a}ab {b}cD{b}{a}" for a in ends for b in ends), (-1, None), (-2, ""), (-3, " \n ")], "doc_id long, text string")
    words = lexical.counted(d, "doc_id", "text")
    assert "split(" not in words._jdf.queryExecution().toString()
    wanted = {i: Counter(t) for i, t in d.select("doc_id", lexical_tokens(F.col("text"))).collect()}
    got = {r["doc_id"]: (r["len"], Counter(dict(zip(r["terms"], r["tfs"], strict=True)))) for r in words.collect()}
    assert got == {i: (t.total(), t) for i, t in wanted.items()}


@pytest.mark.parametrize("name", ["result_analytics", "diversify"])
def test_pools_are_made_without_joined_postings(spark, monkeypatch, name):
    """No task sorts or sums pairs of a question and a document: candidates come from each task's best."""
    monkeypatch.setattr(lexical, "scores", lambda *_: pytest.fail("postings were joined with questions"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["result_analytics", "diversify", "bm25_topk"])
def test_ids_that_come_twice_join_no_postings(spark, tmp_path, monkeypatch, name):
    """Rows that share an id, or have none, are one document's words with each row's length, summed where they are read."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    again = d.where("doc_id % 9 = 0").withColumn("text", F.reverse(F.lower("text"))).unionByName(d.where("doc_id % 18 = 0")).unionByName(d.where("doc_id % 36 = 0"))
    none = d.where("doc_id % 50 = 1").withColumn("doc_id", F.lit(None).cast("long"))
    empty = d.where("doc_id in (7, 9)").withColumn("text", F.lit("")).unionByName(d.limit(2).withColumn("doc_id", F.lit(777_777).cast("long")).withColumn("text", F.lit(" ")))
    d.unionByName(again).unionByName(none).unionByName(empty).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for t in ("benchmark", "embeddings"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    monkeypatch.setattr(lexical, "scores", lambda *_: pytest.fail("postings were joined with questions"))
    got = [sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) for _ in range(2)]
    assert got[0] == got[1] == sorted(con.execute(ORACLES[name]).fetchall())


def shuffled(spark, run) -> int:
    """Rows that a run writes to shuffles."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_pruned_shuffles_blocks_and_no_postings(spark, tmp_path):
    """Nor pairs of a question and a document: many middling terms bring up most documents of each question."""
    d = spark.createDataFrame([(i, " ".join(f"x{i * j % 211}" for j in range(1, 60))) for i in range(2000)], "doc_id long, text string")
    index = lexical.build(d)
    q = spark.createDataFrame([(n, " ".join(f"x{n * 7 + j}" for j in range(30))) for n in range(5)], "qid long, text string")
    found, postings = [], index.postings.count()
    n = shuffled(spark, lambda: found.extend(pruned.top(pruned.build(index, f"{tmp_path}/b"), index, q, 5).collect()))
    key = lambda r: (r["qid"], r["doc_id"], r["score"], r["rank"])
    assert sorted(map(key, found)) == sorted(map(key, lexical.top(index, q, 5).collect()))
    assert postings > 90_000 and n < postings / 5


def test_pruned_weighs_repeated_ids_with_each_length(spark, tmp_path, monkeypatch):
    """Over many segments, and where questions take several passes."""
    monkeypatch.setattr(pruned, "SEGMENT", 40)
    monkeypatch.setattr(pruned, "TAKEN", 4)
    rows = [(i % 70, " ".join(f"w{i * j % 13}" for j in range(1, 3 + i % 9))) for i in range(100)] + [(None, "w1 w2")]
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string"))
    q = spark.createDataFrame([("a", "w1 w2 w3"), ("b", "w4 w4 w0"), ("c", "w12"), (None, "w1")], "qid string, text string")
    blocks = pruned.build(index, f"{tmp_path}/b", block=4)
    assert index.merged is not None and blocks.headers.select("segment").distinct().count() > 5
    key = lambda r: (r["qid"], r["doc_id"], r["score"], r["rank"])
    want = sorted(map(key, lexical.top(index, q, 6).collect()))
    assert sorted(map(key, pruned.top(blocks, index, q, 6).collect())) == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 3)
    assert sorted(map(key, pruned.top(blocks, index, q, 6).collect())) == want
