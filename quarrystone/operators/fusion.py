"""Fusion of the arms, boosts, caps, thresholds, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.sources.shared import few


def by_intent(intent: Column, field: str) -> Column:
    """A number of the intent's budget."""
    out = F.lit(getattr(config.BUDGETS[config.DISCOVERY], field))
    for name, budget in config.BUDGETS.items():
        out = F.when(intent == name, F.lit(getattr(budget, field))).otherwise(out)
    return out


def fused(dense: DataFrame, lexical: DataFrame, intents: DataFrame, most: int | None = None, digits: int = 6) -> DataFrame:
    """Weighted reciprocal ranks of (qid, doc_id, rank) of both arms, full outer; the best
    ``most`` or as many as the intent allows.  Ties: dense rank, lexical rank, doc_id."""
    a = dense.select("qid", "doc_id", F.col("rank").alias("dense_rank"))
    b = lexical.select("qid", "doc_id", F.col("rank").alias("lexical_rank"))
    d = a.join(b, ["qid", "doc_id"], "full_outer").join(F.broadcast(intents), "qid")
    part = lambda weight, rank: F.coalesce(by_intent(F.col("intent"), weight) / (config.RRF + F.col(rank)), F.lit(0.0))
    d = d.withColumn("score", F.round(part("dense_weight", "dense_rank") + part("lexical_weight", "lexical_rank"), digits))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "doc_id")
    limit = F.lit(most) if most is not None else by_intent(F.col("intent"), "merged")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def reranked(d: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranks anew by score, the old rank breaking ties."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "doc_id")
    return d.withColumn("rank", F.row_number().over(w))


def boosted_latest(d: DataFrame) -> DataFrame:
    add = F.when((F.col("layer") == "latest") & (F.col("intent") != config.EXPLANATORY), config.LATEST_BOOST).otherwise(0.0)
    return d.withColumn("score", F.round(F.col("score") + add, 6))


def boosted_summary(d: DataFrame, summary: Column) -> DataFrame:
    add = F.lit(0.0)
    for section, boost in config.SUMMARY_BOOSTS.items():
        add = F.when(F.col("section") == section, boost).otherwise(add)
    return d.withColumn("score", F.round(F.col("score") + F.when(summary, add).otherwise(0.0), 6))


def section_factor(section: Column, intent: Column) -> Column:
    out = F.lit(1.0)
    for s, base in config.SECTION_WEIGHTS.items():
        own = F.lit(base)
        for i, preferred in config.SECTION_PREFERENCES.items():
            if s in preferred:
                own = F.when(intent == i, base * preferred[s]).otherwise(own)
        out = F.when(section == s, own).otherwise(out)
    return out


def recency_factor(published: Column, intent: Column, as_of: str) -> Column:
    recent = published >= F.date_sub(F.to_date(F.lit(as_of)), config.RECENT_DAYS)
    return F.when((intent == config.SOTA) & F.coalesce(recent, F.lit(False)), config.BUDGETS[config.SOTA].recency).otherwise(1.0)


def pruned(d: DataFrame) -> DataFrame:
    """Explanatory questions keep signal sections and phrases, and always the first three rows."""
    strong = F.col("section").isin("method", "abstract", "introduction", "background") | F.lower("text").rlike("|".join(config.SIGNAL_PHRASES))
    return d.where((F.col("intent") != config.EXPLANATORY) | (F.col("rank") <= 3) | strong)


def capped(d: DataFrame, most: int = config.PAPER_CAP, paper: str = "paper_id") -> DataFrame:
    """At most so many rows of a paper; rows without a paper aren't capped."""
    w = Window.partitionBy("qid", paper).orderBy("rank")
    d = d.withColumn("nth", F.row_number().over(w))
    return d.where((F.coalesce(F.col(paper).cast("string"), F.lit("")) == "") | (F.col("nth") <= most)).drop("nth")


def after_year(d: DataFrame, year: int, known: Column) -> DataFrame:
    """Known papers must be that young, undated ones go; unknown ones stay; blank ids go."""
    return d.where((F.coalesce(F.col("paper_id").cast("string"), F.lit("")) != "") & (~known | F.coalesce(F.year("published") >= year, F.lit(False))))


def above_threshold(d: DataFrame, intent: Column) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("qid"))
    strict = intent.isin(config.TECHNICAL, config.EXPLANATORY, config.EVIDENCE, config.SOTA)
    return d.withColumn("top", top).where(~strict | (F.col("score") >= F.least(F.col("top"), F.greatest(F.lit(0.2), 0.7 * F.col("top"))))).drop("top")


def context_size(intent: Column, asked: int, chat: bool = False) -> Column:
    """Passages of an answer: what the intent takes, a query's at most as many as asked for,
    a chat's at least as many."""
    size = by_intent(intent, "context")
    return F.greatest(F.lit(asked), size) if chat else F.least(F.lit(asked), size)


def with_foundation(pool: DataFrame, n: int | Column) -> DataFrame:
    """The best n of each question; if none is foundational, the last gives way to the
    pool's best that is."""
    base = F.col("layer").isin("prerequisite", "foundation")
    n = F.lit(n) if isinstance(n, int) else n
    d = pool.withColumn("size", F.least(n, F.count(F.lit(1)).over(Window.partitionBy("qid"))))
    d = d.withColumn("has", F.max(F.when((F.col("rank") <= n) & base, 1).otherwise(0)).over(Window.partitionBy("qid")))
    d = d.withColumn("best", F.min(F.when(base, F.col("rank"))).over(Window.partitionBy("qid")))
    swap = (F.col("has") == 0) & F.col("best").isNotNull()
    kept = F.when(swap, (F.col("rank") < F.col("size")) | (F.col("rank") == F.col("best"))).otherwise(F.col("rank") <= n)
    return d.where(kept).drop("size", "has", "best")


def neighbours(edges: DataFrame) -> DataFrame:
    """Citation edges (source, target) both ways, once each."""
    return edges.select("source", "target").union(edges.select(F.col("target"), F.col("source"))).distinct()


def boosted_citations(d: DataFrame, edges: DataFrame, first: int = 25) -> DataFrame:
    """Papers that neighbour the best ones, and aren't among them, are lifted."""
    seeds = d.where(F.col("rank") <= first).select("qid", "paper_id").distinct()
    near = seeds.join(neighbours(edges), F.col("paper_id") == F.col("source")).select("qid", F.col("target").alias("paper_id")).distinct()
    near = near.join(seeds, ["qid", "paper_id"], "left_anti").withColumn("near", F.lit(True))
    d = d.join(near, ["qid", "paper_id"], "left")
    plain = F.col("intent").isin(config.TECHNICAL, config.EVIDENCE, config.EXPLANATORY)
    add = F.when(F.col("near") & ~plain, config.CITATION_BOOST).otherwise(0.0)
    return reranked(d.withColumn("score", F.round(F.col("score") + add, 6)).drop("near"))


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, k: int, trade: float) -> list[int]:
    """Greedy maximal marginal relevance, from the best on; ties to the earlier row."""
    n = len(relevance)
    if n <= k:
        return list(range(n))
    span = relevance.max() - relevance.min()
    rel = (relevance - relevance.min()) / span if span > 0 else np.ones(n)
    sims = vectors @ vectors.T
    chosen, nearest = [0], sims[0].copy()
    left = np.ones(n, bool)
    left[0] = False
    while len(chosen) < k:
        value = np.where(left, np.round(trade * rel - (1 - trade) * nearest, 9), -np.inf)
        at = int(value.argmax())
        chosen.append(at)
        left[at] = False
        nearest = np.maximum(nearest, sims[at])
    return chosen


def mmr(pool: DataFrame, vectors: DataFrame, k: int, *, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, position).  A question's pool is at most four times k rows, so a group is small."""
    d = few(pool.where(F.col("rank") <= 4 * k), "relevant").join(vectors.select(F.col(key), F.col(vector).alias("v")), key).select("qid", F.col(key).alias("key"), "rank", "score", by_intent(F.col("intent"), "mmr").alias("trade"), "v")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "key"])
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        order = mmr_order(pdf["score"].to_numpy(float), v, k, float(pdf["trade"].iloc[0]))
        out = pdf.iloc[order][["qid", "key"]].copy()
        out["position"] = np.arange(1, len(order) + 1, dtype=np.int64)
        return out

    return d.groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, key {kinds['key']}, position long").withColumnRenamed("key", key)


def diversified(pool: DataFrame, n: int, per_paper: int = 4) -> DataFrame:
    """The best n with at most ``per_paper`` rows of a paper; rows over the cap fill what is left."""
    w = Window.partitionBy("qid", "paper_id").orderBy("rank")
    d = pool.withColumn("late", (F.row_number().over(w) > per_paper).cast("int"))
    w = Window.partitionBy("qid").orderBy("late", "rank")
    return d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("late")


def novel(pool: DataFrame, n: int, per_paper: int = 4, first: int = 6) -> DataFrame:
    """(qid, doc_id, paper_id, section, position): a pool of up to n rows as it is; of a larger one
    greedily, by rank, rows of sections not seen yet, and any for the first ``first``, at most
    ``per_paper`` of a paper; then the best of the rest fill what is left.  Rows without a paper
    aren't capped.  A fold over each question's pool, which the budgets bound, in the JVM."""
    row = F.struct("rank", "doc_id", F.coalesce(F.col("paper_id").cast("string"), F.lit("")).alias("paper"), F.coalesce("section", F.lit("other")).alias("section"), "paper_id")
    d = pool.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.array().cast("array<string>").alias("sections"), F.array().cast("array<string>").alias("papers"))

    def step(fill: bool):
        def take(a, i):
            x = F.get(F.col("rows"), i)
            free = (x["paper"] == "") | (F.size(F.filter(a["papers"], lambda p: p == x["paper"])) < per_paper)
            fresh = ~F.array_contains(a["chosen"], i) if fill else ~F.array_contains(a["sections"], x["section"]) | (F.size(a["chosen"]) < min(n, first))
            more = F.struct(F.array_append(a["chosen"], i).alias("chosen"), F.array_append(a["sections"], x["section"]).alias("sections"), F.array_append(a["papers"], x["paper"]).alias("papers"))
            return F.when((F.size(a["chosen"]) < n) & free & fresh, more).otherwise(a)

        return take

    places = F.sequence(F.lit(0), F.size("rows") - 1)
    d = d.withColumn("chosen", F.aggregate(places, start, step(False)))
    d = d.withColumn("chosen", F.aggregate(places, F.col("chosen"), step(True), lambda a: a["chosen"]))
    d = d.withColumn("chosen", F.when(F.size("rows") <= n, places).otherwise(F.col("chosen")))
    d = d.select("qid", F.posexplode(F.transform("chosen", lambda i: F.get(F.col("rows"), i))).alias("position", "x"))
    return d.select("qid", "x.doc_id", "x.paper_id", "x.section", (F.col("position") + 1).cast("long").alias("position"))
