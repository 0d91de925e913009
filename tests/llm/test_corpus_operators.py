"""Toxicity, mixing, Jaccard join, LM, decontamination, sharding, pipeline against plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarrystone.llm import decontaminate, hashing, jaccard_join, language_model, mixing, queries, sharding, toxicity
from quarrystone.llm.components import components

ODD = [None, "", "  \n", "a", "a b", "A B", "one two three", "x " * 50]


def crc(i):
    return zlib.crc32(str(i).encode())


def random_texts(n, seed, words=400, size=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(words)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, size))) for _ in range(n)]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "s%d" % (i % 3), "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, key string").repartition(3)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
    return " ".join(w)


def families(seed):
    """Copies, near copies of one base, chains, and texts that share a passage."""
    r = random.Random(seed)
    base = [" ".join("b%d" % r.randrange(3000) for _ in range(r.choice([12, 60, 300]))) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        texts += [b, b.upper()]
        for _ in range(8):
            texts.append(edited(b, r, r.choice([1, 1, 2, 5])))
    passage = " ".join("p%d" % k for k in range(55))
    texts += [passage + " " + " ".join("q%d" % r.randrange(10**6) for _ in range(90)) for _ in range(25)]
    chain = base[1]
    for _ in range(6):
        chain = edited(chain, r, 1)
        texts.append(chain)
    return texts


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(spark, k, percent):
    texts = families(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs_of(spark, texts), k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


def test_jaccard_join_of_nothing(spark):
    lost = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    assert Counter(tuple(r[1:3]) for r in jaccard_join.join(lost, k=3, percent=90).collect()) == Counter([(2, None), (2, 3), (0, None)])
    assert jaccard_join.join(docs_of(spark, ODD).limit(0)).count() == 0


def test_jaccard_join_of_long_texts_and_large_groups(spark):
    """Long texts, some linked and some with half of their words in common, and 3,000 near copies."""
    r = random.Random(12)
    texts = []
    for n in (2000, 20_000):
        for _ in range(3):
            base = ["l%d" % r.randrange(10**6) for _ in range(n)]
            texts += [" ".join(base), edited(" ".join(base), r, n // 90), edited(" ".join(base), r, n // 20)]
            texts += [" ".join(base[: n // 2] + ["m%d" % r.randrange(10**6) for _ in range(n // 2)]) for _ in range(2)]
    groups = brute_components(texts, 5, 80)
    base = " ".join("c%d" % r.randrange(10**6) for _ in range(120))
    texts += [edited(base, r, 1) for _ in range(3000)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(docs_of(spark, texts)).collect()}
    assert {i: got[i] for i in groups} == groups and len({g for _, g in groups.values()}) > 12
    assert {got[i][1] for i in range(len(groups), len(texts))} == {len(groups)}


def test_jaccard_join_of_repeated_ids(spark):
    """Rows of one id with other texts are judged each for itself."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    d = spark.createDataFrame([(1, a), (7, a), (7, b), (8, b), (8, b)], "doc_id long, text string")
    got = Counter((x["doc_id"], x["component_id"], x["n_copies"]) for x in jaccard_join.join(d).collect())
    assert got == Counter({(1, 1, 2): 1, (7, 1, 2): 1, (7, 7, 3): 1, (8, 7, 3): 2})


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 399))
@settings(max_examples=100, deadline=None)
def test_bit_counts_bound_from_above(a, more, cut):
    x = np.array(sorted(a), np.uint64)
    y = np.array(sorted({*x[min(cut, len(x) - 1) :].tolist(), *more}), np.uint64)
    common = len(set(x.tolist()) & set(y.tolist()))
    assert jaccard_join.most_common(jaccard_join.signature_of(x, 16), len(x), jaccard_join.signature_of(y, 8), len(y)) >= common
    assert (jaccard_join.shortened(jaccard_join.signature_of(x, 32), 8) == jaccard_join.signature_of(x, 8)).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 300 + i) for i in range(50)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    least = {}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(near):
        if n not in least:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in least:
                    least[x] = n
                    stack += near[x]
    assert got == {n: m for n, m in least.items() if n != m}


def test_word_hashes_follow_words():
    texts = [b"", b" a  b\n", b"a", b"\x0b b a \x1c b"]
    words, at = hashing.word_hashes(texts)
    of = {w: hashing.word_hashes([w])[0][0] for w in (b"a", b"b", b"\x1c")}
    expected = [of[w] for w in (b"a", b"b", b"a", b"b", b"a", b"\x1c", b"b")]
    assert words.tolist() == expected and at.tolist() == [0, 0, 2, 3, 7]


def test_language_model_base_and_filter(spark):
    texts = ODD + random_texts(80, 7)
    d = docs_of(spark, texts)
    small = language_model.Settings(classes=20, head=50)
    got = {r["doc_id"]: r for r in language_model.score(d, settings=small).collect()}
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
        assert r["score"] < 0
    assert language_model.score(d.limit(0), settings=small).count() == 0


@pytest.mark.parametrize(("classes", "head", "off"), [(1, 3, 1e-6), (1, 50, 1e-6), (1, 10**6, 1e-6), (20, 50, 0.12)])
def test_language_model_counts_pairs_of_all_words(spark, classes, head, off):
    """Against plain counts: exact but for pairs of two classes, whose counts are quantised."""
    texts = ODD + random_texts(80, 7) + ["rare1 rare2 rare3 rare2", "rare2 rare3", "rare1 rare2 rare4"]
    got = {r["doc_id"]: r for r in language_model.score(docs_of(spark, texts), settings=language_model.Settings(classes=classes, head=head)).collect()}
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in enumerate(texts)}
    learn = [ws for i, ws in tokens.items() if crc(i) % 10]
    counts = Counter(w for ws in learn for w in ws)
    pairs = Counter(p for ws in learn for p in zip([None, *ws], ws))
    total = sum(counts.values()) + 0.1 * (len(counts) + 1)
    assert len(got) == len(texts)
    for i, ws in tokens.items():
        if len(ws) > 1 or classes > 1:  # pair of two end tokens: quantised
            exact = sum(math.log10((pairs[h, w] + 300 * (counts[w] + 0.1) / total) / (counts[h] + 300)) for h, w in zip([None, *ws], ws))
            assert got[i]["score"] == pytest.approx(exact, abs=off * len(ws))


def test_count_filter():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**40, 5000))
    counts = rng.zipf(1.5, len(keys)).clip(1, 10**6)
    f = language_model.CountFilter(keys, counts)
    got = f.counts(keys)
    assert (got >= counts / 1.31 - 1).all()  # never below its step
    assert (np.abs(np.log(got / counts)) < math.log(1.3) + 0.3).mean() > 0.95
    assert (f.counts(keys + 2**41) > 0).mean() < 0.02


def test_language_model_prefers_the_order_it_learned(spark):
    texts = ["one two three four five six seven eight"] * 200 + ["eight six four two seven five three one", "one two three four five six seven eight"]
    ids = [i for i in range(2000) if crc(i) % 10][:200] + [i for i in range(2000) if crc(i) % 10 == 0][:2]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score(d).collect()}
    shuffled, same = got[ids[-2]], got[ids[-1]]
    assert same["base_score"] == pytest.approx(shuffled["base_score"])
    assert same["score"] > shuffled["score"] + 3 and same["score"] > same["base_score"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text(alphabet="abc", min_size=1, max_size=9), st.text(alphabet="abc", max_size=14))
@settings(max_examples=200, deadline=None)
def test_myers_distance(pattern, text):
    anywhere = min(levenshtein(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    anchored = min(levenshtein(pattern, text[:j]) for j in range(len(text) + 1))
    d, end = decontaminate.myers(pattern, text)
    assert d == anywhere and d == min(levenshtein(pattern, text[i:end]) for i in range(end + 1))
    assert decontaminate.myers(pattern, text, anchored=True)[0] == anchored


def test_decontamination(spark):
    r = random.Random(5)
    letters = "abcdefgh "
    items = ["".join(r.choice(letters) for _ in range(r.choice([12, 40, 130]))).strip() + "x" for _ in range(12)] + ["", "  "]
    texts = list(ODD)
    for k in range(60):
        t = "".join(r.choice(letters) for _ in range(r.choice([0, 50, 400])))
        if k % 2:
            item = list(r.choice(items[:12]))
            for _ in range(r.randrange(0, 2 + len(item) // 10)):
                item[r.randrange(len(item))] = r.choice(["", "z", "ab"])
            at = r.randrange(len(t) + 1)
            t = t[:at] + "".join(item).upper().replace(" ", " \n ") + t[at:]
        texts.append(t)
    d = docs_of(spark, texts)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rate = 0.08
    got = {(x["doc_id"], x["item_id"]): (x["start"], x["end"], x["distance"]) for x in decontaminate.matches(d, b, rate=rate).collect()}
    expected = {}
    for i, t in enumerate(texts):
        t = decontaminate.normalise(t or "")
        for j, item in enumerate(map(decontaminate.normalise, items)):
            if item and decontaminate.myers(item, t)[0] <= int(rate * len(item)):
                expected[i, j] = decontaminate.myers(item, t)[0]
    assert {k: x[2] for k, x in got.items()} == expected
    for (i, j), (start, end, distance) in got.items():
        assert levenshtein(decontaminate.normalise(items[j]), decontaminate.normalise(texts[i])[start:end]) == distance
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0


def test_mixing_meets_weights_and_limits(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(1, 30), "big" if i % 3 else ("mid" if i % 2 else r.choice(["s1", "s2", None]))) for i in range(3000)] + [(-1, None, "empty"), (-2, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    total = Counter()
    for i, s in of.items():
        total[s] += size[i]
    out = mixing.mix_tokens(d, mixing.Target(budget=1.0, most_repeats=2.0)).collect()
    got = Counter()
    times = Counter()
    for x in out:
        assert x["n_tokens"] == size[x["doc_id"]] and x["source"] == of[x["doc_id"]]
        got[x["source"]] += x["n_tokens"]
        times[x["doc_id"]] += 1
    everything = sum(total.values())
    ratios = {s: got[s] / total[s] for s in total if total[s]}
    assert max(ratios.values()) == pytest.approx(2.0, abs=0.02) and sum(got.values()) == pytest.approx(everything, rel=0.01)
    weights = {x["source"]: x["weight"] for x in out}
    for s in ratios:
        assert weights[s] * everything - 31 <= got[s] <= weights[s] * everything + 1
        assert {times[i] for i in of if of[i] == s} <= {math.floor(ratios[s]), math.floor(ratios[s]) + 1}
    logs = {s: math.log(weights[s]) / 1 for s in ("big", "mid")}
    slope = (logs["big"] - logs["mid"]) / (math.log(total["big"]) - math.log(total["mid"]))
    small = math.log(weights["mid"] / weights["s1"]) / math.log(total["mid"] / total["s1"])
    assert slope == pytest.approx(small, abs=1e-6) and 0 <= slope <= 1
    whole = mixing.mix(d, mixing.Target(most_repeats=2.0)).select(f"{mixing.ROW}.*")
    assert whole.columns == d.columns and whole.select("doc_id").distinct().count() == len(rows)
    h = mixing.mix_tokens(d, mixing.Target(budget=1.0, entropy=1.2)).select("source", "weight").distinct().collect()
    assert -sum(x["weight"] * math.log(x["weight"]) for x in h if x["weight"]) == pytest.approx(1.2, abs=1e-4)
    assert mixing.mix_tokens(d.limit(0), mixing.Target(most_repeats=2.0)).count() == 0


def test_sharding(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcé\n") for _ in range(r.choice([0, 5, 80, 400]))) for _ in range(1500)] + ["hot text " * 8] * 900 + [None, None, ""]
    d = docs_of(spark, texts).unionByName(docs_of(spark, texts[:3]))
    rows = sharding.shard(d, 8).collect()
    assert len(rows) == len(texts) + 3
    size, slots = Counter(), defaultdict(list)
    for x in rows:
        data = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * 900
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(d.limit(0)).count() == 0


def test_toxicity_learns_stems(spark):
    r = random.Random(9)
    plain = ["p%d%s" % (k, r.choice(["ing", "ed", "ly"])) for k in range(300)]

    def text(bad):
        w = [r.choice(plain) for _ in range(r.randint(30, 90))]
        for _ in range(4 if bad else 0):
            w[r.randrange(len(w))] = "grobnik" + r.choice(["a", "en", "ova", "x", "s%d" % r.randrange(30)])
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(1200)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5001, None), (5002, ""), (5003, "unknownword")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows if i < 900] + [(5001, None)], "doc_id long, toxic int")
    small = toxicity.Settings(buckets=1 << 14)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(d, toxicity.fit(d, labels, settings=small)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 1203
    assert np.mean([(got[i] >= 0.5) == b for i, _, b in rows if i >= 900]) > 0.97
    none = toxicity.score(d, toxicity.fit(d, labels.limit(0), settings=small)).collect()
    assert len({x["score"] for x in none}) == 1
    assert toxicity.score(d.limit(0), toxicity.Model(np.zeros(16, np.float32), 0.0, toxicity.Settings(buckets=16))).count() == 0


def test_toxicity_on_held_out(spark):
    d = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [x["score"] for x in d if x["toxic"]], [x["score"] for x in d if not x["toxic"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert np.mean([n >= 0.5 for n in neg]) < 0.06 and np.mean([p >= 0.5 for p in pos]) > 0.5


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, ids = docs, []
    from quarrystone.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, "/root/testdata/sf0.001"), name)
        assert kept.columns == docs.columns
        ids.append({r[0] for r in kept.select("doc_id").collect()})
    judged = {r["doc_id"] for r in queries.op3_quality_rules(spark, "/root/testdata/sf0.001").where("kept").collect()}
    assert ids[0] == judged
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(ids[0])
    groups = brute_components([texts[i] for i in order], 5, 80)
    assert ids[1] == {order[g] for _, g in groups.values()}
    leaks = {r["doc_id"] for r in queries.op9_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    assert ids[2] == ids[1] - leaks and ids[3] == ids[2]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in out.select("doc_id").collect()} == ids[3] and out.select("shard").distinct().count() == 8


def test_repeated_rows_of_near_duplicates(spark):
    text = " ".join("t%d" % k for k in range(40))
    d = docs_of(spark, [text, text + " more", None, "", None]).unionByName(docs_of(spark, [text]))
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == Counter([0, 2, 3, 4])


def test_pipeline_decides_on_rows(spark, tmp_path):
    """Rows without an id, or with one in common, don't share a fate; all columns come through."""
    a, b, c, leak = (" ".join(f"{x}{k}" for k in range(70)) for x in "abcl")
    rows = [(None, a), (None, leak), (None, c), (7, a), (7, leak), (7, b), (7, b), (7, b + " more"), (9, b), (10, ""), (11, None)]
    d = spark.createDataFrame([(i, t, "s", "x", 1, "y") for i, t in rows], "doc_id long, text string, source string, mark string, __id int, id string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    of = lambda df: Counter((r["doc_id"], (r["text"] or "")[:2], len(r["text"] or "")) for r in df.collect())
    everything = of(d)
    clean = corpus_pipeline.decontaminated(spark, d, str(tmp_path))
    assert clean.columns == d.columns and of(clean) == Counter({k: n for k, n in everything.items() if k[1] != "l0"})
    once = corpus_pipeline.near_duplicates(spark, d, str(tmp_path))
    got = of(once)
    assert once.columns == d.columns and got[7, "b0", len(b)] + got[7, "b0", len(b) + 5] == 1 and got[9, "b0", len(b)] == 0
    assert all(got[k] == n for k, n in everything.items() if k[1] != "b0")
    kept = corpus_pipeline.quality(spark, d, str(tmp_path))
    assert kept.columns == d.columns and kept.count() == 9
    assert corpus_pipeline.mixed(spark, d, str(tmp_path)).columns == d.columns
    assert corpus_pipeline.sharded(spark, d, str(tmp_path)).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_decontamination_in_passes(spark):
    """As many passes as the items take give what one pass gives; repeated items count once."""
    texts = random_texts(40, 3, words=30, size=80)
    items = [(k, texts[k % 40][5:60]) for k in range(60)] + [(3, texts[3][5:60]), (None, texts[4])]
    d, b = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    of = lambda df: Counter(tuple(r) for r in df.collect())
    assert of(decontaminate.matches(d, b, pass_chars=300)) == of(decontaminate.matches(d, b)) == of(decontaminate.matches(d, b.distinct()))
