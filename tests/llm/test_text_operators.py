"""Quality rules, token counts, chat formatting, URL filters against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm import chat_format, quality_rules, queries, token_counts, tokenizer, url_filters
from quarrystone.llm.common import words_of
from quarrystone.llm.tokenizer import VOCABULARY, Vocabulary, encoding_of

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [None, "", " \t\n", "a", "a b a b a b a", "one two three one two three", "x\ny\nx\n\n \nx", "A#B $% é|<>&*", "\x0bword\x0cnext\xa0same\u2003still", "w " * 60, "the cat sat on the mat " * 12, "line\n" * 5 + "end", "ÀÉ UPPER!! 123"]


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_words(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r[0]: r[1] for r in d.select("i", words_of(F.col("t"))).collect()}
    assert got == {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}


def test_statistics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    more = [" ".join(rng.choice(list("abc\n|")) for _ in range(n)) for n in range(1, 40, 3)]
    every = TEXTS + more
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(every)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.statistics(d).select(f"{quality_rules.ROW}.doc_id", *quality_rules.BASE).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(every)}


def test_rules_are_learned_and_empty_without_labels(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.5)
    rules = quality_rules.learn_rules(x, bad, ["a", "b", "c"])
    hit = np.zeros(600, bool)
    for r in rules.rules:
        hit |= quality_rules._covers(r.tests, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97 and rules.rules
    assert not quality_rules.learn_rules(np.zeros((0, 3)), np.zeros(0, bool), ["a", "b", "c"]).rules
    assert not quality_rules.learn_rules(x, np.zeros(600, bool), ["a", "b", "c"]).rules
    d = spark.createDataFrame([(1, "w " * 80), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r[0]: r[1] for r in quality_rules.judge(d, quality_rules.fit(d, labels)).select(f"{quality_rules.ROW}.doc_id", "kept").collect()}
    assert out == {1: False, 2: False}


def test_quality_query_on_labels(spark):
    d = queries.op3_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = {tuple(x[:3]): x[3] for x in d.join(labels, "doc_id").groupBy("base_failed", "quality", "kept").count().collect()}
    assert r.get((False, 1, False), 0) <= 0.02 * r[(False, 1, True)]
    assert r.get((False, 0, True), 0) <= 0.25 * r[(False, 0, False)]


@given(st.text(alphabet="\\# :<>/turn\nA", max_size=30), st.text(alphabet="\\# :<>/turn\nA", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escaping_round_trip(role, text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert chat_format.unescape(chat_format.escape(role, True), True) == role
    assert chat_format.parse(chat_format.render(role, text) * 2) == [(role, text)] * 2


def test_tokens_read_back():
    with open(VOCABULARY, "rb") as f:
        encoder, lengths = encoding_of(f.read())
    texts = ["", r"\### Assistant: </turn> ok", "</turn>", "é\u2003∑\n\n  x", "\\\\</turn>\\", "tail\\"]
    roles = ["user", "assistant", "a: b", "### ", "", "assistant"]
    ids, masks = chat_format.assemble(roles, texts, lambda x: encoder.encode_ordinary_batch(x, num_threads=1), len(lengths))
    for r, t, i, m in zip(roles, texts, ids, masks, strict=True):
        assert chat_format.read_turn(i, m, encoder, len(lengths)) == (r, t, t if r == "assistant" else "", len(chat_format.render(r, t)))


def conversations(rows):
    out = {}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.render(r, x)) for _, r, x in turns))
    return out


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn> é"), (1, 2, None, None), (2, 5, "assistant", ""), (3, 0, "system", "x " * 3000), (-7, 1, "assistant", queries.TRICKY), (-7, 0, "user", queries.TRICKY), (None, 0, "user", "q")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    v = Vocabulary(spark)
    got = {r[0]: tuple(r[1:6]) for r in chat_format.digests(chat_format.format_turns(d, v), v).collect()}
    assert got == conversations(rows)
    placed = chat_format.in_order(chat_format.format_turns(d, v)).where("conv_id = 1").orderBy("turn").select("start", "n_tokens").collect()
    assert [r[0] for r in placed] == [0, placed[0][1], placed[0][1] + placed[1][1]]
    assert chat_format.digests(chat_format.format_turns(d.limit(0), v), v).count() == 0
    for kind in ("smallint", "date", "string"):
        other = d.withColumn("conv_id", F.when(F.col("conv_id") > 0, F.date_add(F.lit("2020-01-01"), F.col("conv_id").cast("int"))) if kind == "date" else F.col("conv_id").cast(kind))
        assert sorted(r["n_turns"] for r in chat_format.digests(chat_format.format_turns(other, v), v).collect())[-1] == 3


def test_chat_query(spark):
    got = {r[0]: tuple(r[1:6]) for r in queries.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == conversations([*rows, (-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY)])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = [None, "", "a", "one\ntwo\n\n\nthree", "\n\n", "é∑\n∑é 😀\n", "x" * 3000 + "\n" + "y z\n" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = Vocabulary(spark)
    encoder, _ = v.load()
    got = defaultdict(dict)
    for r in token_counts.count_sections(d, v, rule=rule).collect():
        got[r["doc_id"]][r["section"]] = (r["first_char"], r["n_chars"], r["n_tokens"])
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, t in enumerate(texts):
        if not t:
            continue
        _, offsets = encoder.decode_with_offsets(encoder.encode_ordinary(t))
        lines = t.splitlines(keepends=True)
        starts = np.cumsum([0] + [len(x) for x in lines])
        assert [got[i][k][:2] for k in range(len(lines))] == list(zip(starts[:-1], map(len, lines), strict=True))
        assert sum(x[2] for x in got[i].values()) == len(offsets)
        if rule == "start":
            of = np.searchsorted(starts, offsets, "right") - 1
            assert [got[i][k][2] for k in range(len(lines))] == np.bincount(of, minlength=len(lines)).tolist()


def test_most_characters_decide(spark):
    """Rule ``most`` by hand: each token to the line with most of its characters, the first of equals."""
    texts = ["ab\n\n\n  cd ef\n", " \n \n x\n\n\n\n\ny", "é\n\n\té", "one\n two\n\n" * 400]
    d = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").withColumn("section", F.lit("clash"))
    v = Vocabulary(spark)
    encoder, _ = v.load()
    got = defaultdict(dict)
    for r in token_counts.count_sections(d, v, rule="most").collect():
        got[r["doc_id"]][r["section"]] = r["n_tokens"]
    for i, t in enumerate(texts * 2):
        line = np.cumsum([0, *(c == "\n" for c in t)])[:-1]
        expected, at = Counter(), 0
        for token in encoder.encode_ordinary(t):
            part = encoder.decode([token])
            held = Counter(line[at : at + len(part)].tolist())
            expected[max(held, key=lambda k: (held[k], -k))] += 1
            at += len(part)
        assert {k: n for k, n in got[i].items() if n} == expected
    assert token_counts.count_sections(d.limit(0), v, rule="most").count() == 0


def test_boundary_rules():
    bounds, first, last = np.array([0, 3, 10]), np.array([0, 1, 8]), np.array([0, 7, 9])
    assert token_counts.attribute(first, last, bounds, "start").tolist() == [0, 0, 1]
    assert token_counts.attribute(first, last, bounds, "end").tolist() == [0, 1, 1]
    assert token_counts.attribute(first, last, bounds, "most").tolist() == [0, 1, 1]
    with pytest.raises(ValueError):
        token_counts.attribute(first, last, bounds, "other")


def test_token_counts_by_field(spark):
    d = spark.createDataFrame([(1, "a title", None, "body text here")], "doc_id long, title string, mid string, body string")
    got = {r["field"]: r["n_tokens"] for r in token_counts.count_fields(d, ["title", "mid", "body"], Vocabulary(spark)).collect()}
    encoder, _ = Vocabulary(spark).load()
    assert sum(got.values()) == len(encoder.encode_ordinary("a title\n\nbody text here"))


URLS = [None, "", "no scheme", "http://Example.COM", "https://www.example.com/en/x?q#f", "http://a.b.example.com/en/y", "http://x.example.net/es/1", "http://x.example.net/de/1", "http://notexample.com/en/", "s://h?x/y", "http://org/e", "a://b://c/d", "http://net/fr/"]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p) for h, p, _ in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None


def test_url_rules(spark):
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filters.judge_urls(d, queries.URL_RULES).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}
    assert url_filters.judge_urls(d.limit(0), queries.URL_RULES).count() == 0


def test_propagation_matches_power_iteration(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("e", "d", 1)]
    d = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", "trust", 1.0), ("d", "distrust", 1.0)], "host string, kind string, mass double")
    got = {(r["host"], r["kind"]): r["score"] for r in url_filters.propagate(d, seeds, tolerance=1e-10).collect()}
    for kind, seed, edges in (("trust", "a", links), ("distrust", "d", [(y, x, n) for x, y, n in links])):
        out = Counter()
        for x, _, n in edges:
            out[x] += n
        rank = {seed: 1.0}
        for _ in range(200):
            new = Counter({seed: 0.15})
            for x, y, n in edges:
                new[y] += 0.85 * rank.get(x, 0) * n / out[x]
            new[seed] += 0.85 * sum(v for h, v in rank.items() if not out[h])
            rank = new
        for h in "abcde":
            assert got.get((h, kind), 0) == pytest.approx(rank.get(h, 0), abs=1e-3)


def test_propagation_goes_on_until_it_settles(spark):
    far = [(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(60)]
    ring = [("a", "b", 1), ("b", "a", 1)]
    d = spark.createDataFrame(far + ring, "src string, dst string, n long")
    seeds = spark.createDataFrame([("h60", "distrust", 1.0), ("a", "trust", 1.0)], "host string, kind string, mass double")
    got = {(r["host"], r["kind"]): r["score"] for r in url_filters.propagate(d, seeds).collect()}
    assert {h for h, kind in got if kind == "distrust"} == {f"h{i:02}" for i in range(61)}
    assert got["a", "trust"] == pytest.approx(0.15 / (1 - 0.85**2), abs=1e-5)
    assert got["h00", "distrust"] == pytest.approx(0.15 * 0.85**60 / (1 - 0.85**61))
    with pytest.raises(RuntimeError):
        url_filters.propagate(d, seeds, most_rounds=8)


def test_distrust_blocks_hosts_that_link_to_blocked(spark):
    page = lambda i, u, to: (i, u, "".join(f'<a href="{t}">' for t in to))
    rows = [page(1, "http://bad.net/es/1", []), page(2, "http://farm.org/x", ["http://bad.net/es/1"]), page(3, "http://good.com/", ["http://fine.org/"]), page(4, "http://fine.org/", []), page(5, "http://alone.org/", ["/x"])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(d, queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_a_faint_trace_of_distrust_blocks_nobody(spark):
    """In a chain of twelve links towards a blocked host only the near ones are blocked."""
    hosts = [*(f"h{k}.org" for k in range(12, 0, -1)), "bad.net"]
    rows = [(k, f"http://{h}/es/", f'<a href="http://{to}/">') for k, (h, to) in enumerate(zip(hosts, [*hosts[1:], ""], strict=True))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [x["verdict"] for x in url_filters.judge_urls(d, queries.URL_RULES).orderBy("page_id").collect()]
    assert got[0] == "allow" and got[-3:] == ["block"] * 3 and got == sorted(got)


@pytest.mark.parametrize("unit", [" ", "\n", "\u00a0", "x", "\t y"])
def test_texts_of_any_length(spark, unit):
    """Two million characters, white space in a row too; shorter texts keep their tokens."""
    encoder, lengths = Vocabulary(spark).load()
    text = "a" + unit * (2_000_000 // len(unit)) + "b"
    ids = tokenizer.encode(encoder, text)
    assert encoder.decode(ids) == text
    for t in (" " * 65_536 + "b", "a  \n b" * 20_000, unit * 40_000 + " c"):
        assert tokenizer.encode(encoder, t) == encoder.encode_ordinary(t)
    d = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", None), (2, 0, "user", ""), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_turns(d, Vocabulary(spark)), Vocabulary(spark)).collect()}
    assert (got[1]["loss_chars"], got[2]["n_turns"]) == (len(text), 2)
    n = token_counts.count_sections(d.select(F.col("conv_id").alias("doc_id"), "text"), Vocabulary(spark)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert [(r["doc_id"], r["n"]) for r in n] == [(1, len(ids))]


def test_verdicts_match_power_iteration(spark):
    """Every verdict and score from plain Python: links without a scheme, repeated pages, hosts without links."""
    r = random.Random(3)
    hosts = [f"h{k}.{r.choice(['org', 'com', 'net'])}" for k in range(25)]
    urls = [(i, f"http://{r.choice(hosts)}/{r.choice(['es/', 'fr/', 'en/', ''])}{i}") for i in range(80)] + [(200, None), (201, "none")]
    links = {i: [r.choice(hosts) for _ in range(r.choice([0, 0, 1, 3]))] for i, _ in urls}
    rows = [(i, u, "".join(f"<a HREF = '{r.choice(['https:', ''])}//{h}/x'>" for h in links[i])) for i, u in urls]
    rows.append(rows[0])
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit("clash"))
    got = {x["page_id"]: (x["verdict"], x["trust"]) for x in url_filters.judge_urls(d, queries.URL_RULES, tolerance=1e-10).collect()}
    verdict = {h + p: v for h, p, v in queries.URL_RULES}
    seeds, edges = Counter(), Counter()
    for i, u, _ in rows:
        host, _, rule = by_hand(u)
        if rule:
            seeds["distrust" if verdict[rule] == "block" else "trust", host] += 1
        for to in links[i]:
            if host and to != host:
                edges[host, to] += 1
    score = {}
    for kind in ("trust", "distrust"):
        e = edges if kind == "trust" else Counter({(b, a): n for (a, b), n in edges.items()})
        out = Counter()
        for (a, _), n in e.items():
            out[a] += n
        start = {h: n / sum(seeds.values()) for (k, h), n in seeds.items() if k == kind}
        rank = dict(start)
        for _ in range(300):
            new = Counter({h: 0.15 * m for h, m in start.items()})
            for (a, b), n in e.items():
                new[b] += 0.85 * rank.get(a, 0) * n / out[a]
            lost = 0.85 * sum(v for h, v in rank.items() if not out[h])
            for h, m in start.items():
                new[h] += lost * m / sum(start.values())
            rank = new
        score[kind] = rank
    for i, u, _ in rows:
        host, _, rule = by_hand(u)
        t, b = score["trust"].get(host, 0), score["distrust"].get(host, 0)
        marked = [v for v in score["distrust"].values() if v > 0]
        assert got[i][0] == (verdict[rule] if rule else "block" if b > 0 and b >= 0.5 * (t + b) and b >= 0.5 * sum(marked) / len(marked) else "allow")
        if not rule and host:
            assert (got[i][1] or 0) == pytest.approx(t, abs=1e-6)
    assert {v for v, _ in got.values()} == {"allow", "block"}
