"""Bounds, limits and edge cases of the training-data operators."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import mixing, quality_rules, sharding, toxicity
from quarrystone.llm.common import small_batches


def test_fits_are_bounded_where_ids_repeat(spark, monkeypatch):
    """Of an id with many rows a fit takes one, so no more rows than the bound come to the driver."""
    r = random.Random(1)
    text = lambda: " ".join(r.choice("aa bb cc dd ee ff".split()) + str(r.randrange(99)) for _ in range(80))
    rows = [(i, text()) for i in range(60)] + [(5, text()) for _ in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, weights, settings: seen.append(texts))
    toxicity.fit(d, labels, max_rows=20)
    monkeypatch.setattr(quality_rules, "learn_rules", lambda x, bad, **o: seen.append(x))
    quality_rules.fit(d, labels, max_rows=20)
    assert len(seen[0]) == 20 and len(seen[1]) <= 20
    toxicity.fit(d, labels, max_rows=1000)
    assert len(seen[2]) == 60 and min(t for i, t in rows if i == 5) in seen[2]


def test_toxicity_scores_by_hand(spark):
    """Each score from the model's own buckets in plain Python; long, null and repeated rows."""
    rng = np.random.default_rng(2)
    settings = toxicity.Settings(buckets=1 << 10)
    model = toxicity.Model(rng.normal(size=1 << 10).astype(np.float32), -0.3, settings)
    texts = [None, "", "One two, two", "x" * 5000 + " y", "w " * 20_000, "One two, two"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("t", F.lit("clash"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(d, model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").lower().encode().split()
        each = []
        for w in words:
            at, _ = toxicity.subwords([w.strip(toxicity.EDGES)], settings.least, settings.most, settings.buckets)
            each.append(float(np.mean(model.buckets[at].astype(np.float64))))
        x = model.bias + (toxicity.SCALE * sum(each) / len(each) if each else 0.0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(x, -500, 500))), rel=1e-6)


def test_kept_by_the_list_in_plain_python(spark):
    """The verdict is the first rule that fits, over the row's own figures."""
    rules = quality_rules.DecisionList((quality_rules.Rule((("symbol_ratio", True, 0.1),), 3, 0), quality_rules.Rule((("mean_word", False, 3.0), ("log_words", True, 1.8)), 3, 0)))
    texts = [None, "", "word " * 60, "ab " * 70, "## $$ " * 40, "long words here " * 30, "a " * 20_000]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts * 2)], "doc_id int, text string, rule string")
    for r in quality_rules.judge(d, rules).collect():
        fits = [k for k, rule in enumerate(rules.rules) if all((r[n] >= x) if up else (r[n] < x) for n, up, x in rule.tests)]
        assert r["rule"] == (fits[0] if fits else None) and r["kept"] == (not r["base_failed"] and not fits)
    assert quality_rules.judge(d.limit(0), rules).count() == 0


def test_mixing_tells_what_cannot_be_met(spark):
    d = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b") for i in range(40)], "doc_id long, text string, source string")
    for target in (mixing.Target(budget=8.0, most_repeats=2.0), mixing.Target(entropy=0.1), mixing.Target(entropy=0.9)):
        with pytest.raises(ValueError):
            mixing.mix_tokens(d, target)
    again = d.unionByName(d)
    assert mixing.mix_tokens(again, mixing.Target(most_repeats=1.0)).count() == 80


def test_sharding_subdivides_hot_rows(spark):
    """Repeated rows of one id and text, by far more than a range holds, are divided among ranges."""
    r = random.Random(4)
    rows = [(i, "t%d " % i * r.randrange(30)) for i in range(400)] + [(7, "hot " * 20)] * 700 + [(None, None)] * 50 + [(8, "l" * 40_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("range", F.lit(1)).repartition(5)
    records = sharding.stored(sharding._records(d, "doc_id", "text"), "records")
    split, found = sharding.splitters_of(records, 8, most_bytes=8000)
    total = sum(size + sharding.ROW_COST * n for _, n, size in found)
    goal = total / max(8, -(-total // 8000))
    assert sum(n for _, n, _ in found) == len(rows) and max(size + sharding.ROW_COST * n for _, n, size in found if n < 3000 and size < 40_000) <= 3 * goal
    out = sharding.shard(d, 8).collect()
    slots, size = defaultdict(list), Counter()
    for x in out:
        slots[x["shard"]].append(x["slot"])
        size[x["shard"]] += x["size"]
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    three = np.array(split, np.int64).reshape(-1, 3)
    some = [tuple(x) for x in records.select("key", F.coalesce("doc_id", F.lit(sharding.NO_ID)), "row").collect()]
    assert sharding.places(*np.array(some, np.int64).T, three).tolist() == [sum(s < x for s in split) for x in some]


def test_small_batches_end(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    with pytest.raises(KeyError), small_batches(spark):
        assert spark.conf.get(name) == "256"
        raise KeyError
    assert spark.conf.get(name) == was
