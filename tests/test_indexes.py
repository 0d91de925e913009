"""Pruned, approximate and growing indexes against exhaustive ones."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import ann, dense, lexical, pruned, segments
from quarrystone.plans import indexes, retrieval

SF = "/root/testdata/sf0.01"


def rows_of(d):
    return sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in d.collect())


def texts(n: int, seed: int):
    """Frequent and rare words, repeated texts, empty ones and a null."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    some = [" ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randrange(3, 40))) for _ in range(n)]
    return [(i, t if i % 7 else some[0]) for i, t in enumerate(some)] + [(n, ""), (n + 1, None), (n + 2, "only")]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10), (3, 400)])
def test_pruned_equals_exhaustive(spark, tmp_path, seed, k):
    d = spark.createDataFrame(texts(300, seed), "doc_id long, text string")
    index = lexical.build(d)
    q = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w0"), (3, "w59 w58 w0 w0 w0"), (4, "none"), (5, ""), (6, "w3 w40 w17 w2 only"), (7, None)], "qid long, text string")
    blocks = pruned.build(index, str(tmp_path), block=8)
    assert rows_of(pruned.top(blocks, index, q, k)) == rows_of(lexical.top(index, q, k))


def test_pruning_skips_most_postings_of_frequent_terms(spark, tmp_path):
    """Long terms are cut into blocks over tasks, and a rare strong term spares the frequent ones."""
    r = random.Random(9)
    rows = [(i, " ".join(["common"] * r.randrange(1, 4) + ["pad"] * r.randrange(1, 60) + (["rare"] * 3 if i % 150 == 0 else []) + ([f"x{i}"]))) for i in range(3000)]
    rows += [(10_000 + i, f"y{i} z{i}") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexical.build(d)
    q = spark.createDataFrame([(1, "common rare"), (2, "rare common pad"), (3, "common")], "qid long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        blocks = pruned.build(index, str(tmp_path), block=32)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got, read, full = pruned.weighed(blocks, index, q, 10)
    assert rows_of(got) == rows_of(lexical.top(index, q, 10))
    weighed = read.agg(F.sum("size")).first()[0] + full.count()
    every = lexical.question_terms(q).join(index.postings, "term").count()
    assert 2 * weighed <= every
    assert blocks.headers.agg(F.max("size")).first()[0] <= 32
    parts = blocks.postings.where("term = 'common'").select(F.input_file_name()).distinct().count()
    assert parts > 1


@pytest.mark.parametrize("keep", [None, "label % 3 = 0"])
def test_recall_of_probed_lists(spark, keep):
    v, q = retrieval.vectors(spark, SF), retrieval.asked(spark, SF, 5)
    model = ann.fit(v)
    index = ann.indexed(v, model, f"/tmp/spark-{uuid.uuid4().hex}", attributes=("label",))
    got = ann.top(index, v, q, 20, model, keep=None if keep is None else F.expr(keep))
    want = dense.top(v if keep is None else v.where(keep), q, 20)
    a, b = ({(r["qid"], r["vec_id"]): r["score"] for r in d.collect()} for d in (got, want))
    assert len(a.keys() & b.keys()) >= 0.9 * len(b)
    assert all(a[x] == pytest.approx(b[x], abs=2e-6) for x in a.keys() & b.keys())
    assert index.count() == v.count()


def test_probed_lists_are_a_small_part(spark, tmp_path):
    """Vectors in groups: recall by far above 0.9 from less than a fifth of them; hot vectors, nulls and a cosine too."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(60, 24))
    x = centers[r.integers(0, 60, 6000)] + 0.35 * r.normal(size=(6000, 24))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(6000, None)], "vec_id long, embedding array<double>")
    hot = x.copy()
    hot[:2000] = x[0]
    for name, cosine, d in (("dot", False, frame(x)), ("cosine", True, frame(x)), ("hot", False, frame(hot))):
        q = d.where("vec_id % 40 = 0 and embedding is not null").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
        model = ann.fit(d, cosine=cosine, sample=3000)
        index = ann.indexed(d, model, f"{tmp_path}/{name}")
        a, b = ({(s["qid"], s["vec_id"]) for s in found.collect()} for found in (ann.top(index, d, q, 20, model), dense.top(d, q, 20, cosine=cosine)))
        assert len(a & b) >= 0.9 * len(b)
        assert name == "hot" or ann.read_share(index, q, model) < 0.2
    none = d.limit(0)
    model = ann.fit(none)
    assert ann.top(ann.indexed(none, model, f"{tmp_path}/none"), none, q, 5, model).count() == 0


def test_an_index_that_grew_equals_a_rebuild(spark, tmp_path):
    root, old = f"{tmp_path}/a", texts(200, 4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    segments.add(spark, root, frame(old))
    now = dict(old)
    for step in range(3):
        new = [(i, f"w{step} changed w{i % 9}") for i in range(step, 200, 50)] + [(1000 + step, "w1 fresh")]
        gone = [1000 + step - 1, 5 + step, 99_999]
        name = segments.add(spark, root, frame(new), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        now = {i: t for i, t in now.items() if i not in gone} | dict(new)
        assert spark.read.parquet(f"{root}/{name}/docs").count() == len(new)  # nothing else is tokenized
    q = frame([(1, "w0 w1"), (2, "fresh changed"), (3, "w30 w2")]).withColumnRenamed("doc_id", "qid")

    def same(index):
        full = lexical.build(frame(sorted(now.items())))
        key = lambda d, c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*c).collect())
        for part, c in (("postings", ("doc_id", "term", "tf")), ("docs", ("doc_id", "len")), ("terms", ("term", "df", "idf")), ("stats", ("n", "avgdl"))):
            assert key(getattr(index, part), c) == key(getattr(full, part), c), part
        assert rows_of(lexical.top(index, q, 5)) == rows_of(lexical.top(full, q, 5))

    same(segments.load(spark, root))
    held = segments.current(spark, root)
    with pytest.raises(ValueError, match="twice"):
        segments.add(spark, root, frame([(1, "a"), (1, "b")]))
    assert segments.current(spark, root) == held
    segments.compact(spark, root)
    assert len(segments.current(spark, root)) == 1
    same(segments.load(spark, root))
    with pytest.raises(ValueError):
        segments.load(spark, f"{tmp_path}/nowhere")


def test_a_segment_that_lost_papers_is_not_made_current(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/a"
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    segments.add(spark, root, d)
    held = segments.current(spark, root)
    monkeypatch.setattr(segments.Index, "consistent", lambda self: False)
    with pytest.raises(ValueError, match="statistics"):
        segments.add(spark, root, d.withColumn("doc_id", F.col("doc_id") + 5))
    assert segments.current(spark, root) == held


def test_queries_agree(spark):
    want = rows_of(retrieval.bm25_topk(spark, SF))
    assert rows_of(indexes.bm25_pruned(spark, SF)) == want
