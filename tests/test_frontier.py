"""Growth along citations and section novelty against plain-Python twins."""

from __future__ import annotations

import random

import pytest

from quarrystone import config
from quarrystone.operators import frontier, fusion
from quarrystone.plans import growth, retrieval

SF = "/root/testdata/sf0.001"


def layer(year, ref):
    return "core" if year is None else "prerequisite" if year <= 2019 or (ref and year <= 2022) else "foundation" if year <= 2022 else "core" if year <= 2024 else "latest"


def grown(papers, links, rounds, cap, relevant):
    """papers by id: [title, abstract, layer, seed]; links: rows as tuples in column order."""
    papers = {k: list(v) for k, v in papers.items()}
    at, edges, counts = {k for k, v in papers.items() if v[3]}, set(), []
    for _ in range(rounds):
        tally = dict.fromkeys(("no_title", "not_relevant", "open", "quota", "cap", "taken"), 0)
        arrivals = []
        for s, p, direction, title, abstract, year, place in links:
            if s in at and p:
                gate = "no_title" if not (title or "").strip() else "open" if relevant(title, abstract or "") else "not_relevant"
                tally[gate] += 1
                if gate == "open":
                    ref = direction == "reference"
                    arrivals.append((s, not ref, place, p, direction, title, abstract, layer(year, ref)))
        first = {}
        for a in sorted(arrivals, key=lambda a: a[:4]):
            first.setdefault(a[3], a)
        count, total, taken = {}, len(papers), set()
        for v in papers.values():
            count[v[2]] = count.get(v[2], 0) + 1
        for p, a in first.items():
            if p in papers:
                continue
            n, of = count.get(a[7], 0), a[7]
            if a[1] and of in config.LAYER_SHARES and n / max(total, 1) >= config.LAYER_SHARES[of] and n % 3:
                tally["quota"] += 1
            else:
                count[of], total = n + 1, total + 1
                tally["cap" if total > cap else "taken"] += 1
                if total <= cap:
                    taken.add(p)
        for p, a in first.items():
            if p in papers:
                old = papers[p]
                papers[p] = [a[5] or old[0], a[6] or old[1], a[7], old[3]]
            elif p in taken:
                papers[p] = [a[5], a[6], a[7], False]
        edges |= {(a[0], a[3], a[4]) for a in arrivals if a[3] in papers}
        counts.append({k: v for k, v in tally.items() if v})
        at = taken
    return papers, edges, counts


@pytest.mark.parametrize("cap", [10**6, 45])
def test_rounds_by_hand(spark, tmp_path, cap):
    r = random.Random(2)
    word = config.RELEVANT[0]
    papers = {f"p{k:03}": [f"t{k}", "a", r.choice(frontier.LAYERS), k < 4] for k in range(20)}
    ids = [f"p{k:03}" for k in range(120)]
    seen, links = set(), [(None, "p001", "citation", word, "x", 2000, 1), ("p001", "", "citation", word, "x", 2000, 1)]
    for k in range(700):
        s, p, direction = r.choice(ids), r.choice(ids), r.choice(["reference", "citation", "citation"])
        if (s, p, direction) not in seen:
            seen.add((s, p, direction))
            links.append((s, p, direction, r.choice([f"{word} {k}"] * 4 + ["", "off"]), r.choice(["abstract", None]), r.choice([None, 2015, 2021, 2024, 2025, 2025, 2025]), k))
    d = spark.createDataFrame(links, "source string, paper_id string, direction string, title string, abstract string, year int, place int")
    have = spark.createDataFrame([(k, *v) for k, v in papers.items()], "paper_id string, title string, abstract string, layer string, is_seed boolean")
    edges = spark.createDataFrame([], "source string, target string, direction string")
    run = lambda: frontier.expand(have, edges, d, f"{tmp_path}/r", rounds=3, cap=cap, block=16)
    want = grown(papers, links, 3, cap, lambda t, a: word in f"{t} {a}".lower())
    for got in (run(), run()):  # the second finds all rounds written
        assert {x["paper_id"]: [x["title"], x["abstract"], x["layer"], x["is_seed"]] for x in got["papers"].collect()} == want[0]
        assert {tuple(x) for x in got["edges"].collect()} == want[1] and got["edges"].count() == len(want[1])
        assert [{x["gate"]: x["n"] for x in got["counts"].collect() if x["round"] == k and x["n"]} for k in range(3)] == want[2]
    assert cap > 1000 or len(want[0]) == 45


def test_frontier_query_by_hand(spark):
    have, _, links = growth.citation_graph(spark, SF)
    papers = {x[0]: list(x[1:]) for x in have.collect()}
    relevant = lambda t, a: any(w in f"{t} {a}".lower() for w in config.RELEVANT)
    want, edges, _ = grown(papers, [tuple(x) for x in links.collect()], 2, 2 * len(papers), relevant)
    got = {x["paper_id"]: (x["layer"], x["is_seed"], x["n_edges"]) for x in growth.frontier_expansion(spark, SF).collect()}
    assert got == {p: (v[2], v[3], sum(t == p for _, t, _ in edges)) for p, v in want.items()} and len(got) > len(papers)


def chosen(rows, n, per_paper, first=6):
    if len(rows) <= n:
        return [r[1] for r in rows]
    out, sections, papers = [], set(), {}
    for fill in (False, True):
        for rank, doc, paper, section in rows:
            if len(out) < n and doc not in out and (not paper or papers.get(paper, 0) < per_paper) and (fill or section not in sections or len(out) < min(n, first)):
                out.append(doc)
                sections.add(section)
                papers[paper] = papers.get(paper, 0) + 1
    return out


@pytest.mark.parametrize("n,per_paper", [(12, 2), (3, 1), (200, 4)])
def test_section_novelty_by_hand(spark, n, per_paper):
    pool = retrieval.pool(spark, SF).select("qid", "doc_id", "rank", "section", "paper_id").collect()
    r = random.Random(1)
    pool = [(x["qid"], x["doc_id"], x["rank"], r.choice([x["section"], "other", None]), r.choice([x["paper_id"]] * 5 + ["", None])) for x in pool]
    got = {}
    d = fusion.novel(spark.createDataFrame(pool, "qid long, doc_id long, rank int, section string, paper_id string"), n, per_paper)
    for x in d.collect():
        got.setdefault(x["qid"], {})[x["position"]] = x["doc_id"]
    by = {}
    for q, doc, rank, section, paper in pool:
        by.setdefault(q, []).append((rank, doc, paper or "", section or "other"))
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == {q: chosen(sorted(rows), n, per_paper) for q, rows in by.items()}
