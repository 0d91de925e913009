"""Counts, health, balance and latency reports."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions.text import era_of
from quarrystone.operators import quantiles
from quarrystone.sources.shared import stored

#: Least and most share of an era in percent.
TARGETS = {"early_2017_2020": (20, 30), "middle_2021_2023": (35, 45), "recent_2024_plus": (25, 35)}


def era_counts(d: DataFrame, year) -> DataFrame:
    """(era, n); rows without a year don't count."""
    return d.select(era_of(year).alias("era")).where("era is not null").groupBy("era").agg(F.count(F.lit(1)).alias("n"))


def era_shares(counts: DataFrame) -> DataFrame:
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / total, 1))


def balance(counts: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """(era, n, pct, status, needed) of every era with a target; eras come in handfuls."""
    rows = [(e, float(a), float(b)) for e, (a, b) in targets.items()]
    t = counts.sparkSession.createDataFrame(rows, "era string, least double, most double")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    d = t.join(counts, "era", "left").join(F.broadcast(total), F.lit(True)).withColumn("n", F.coalesce("n", F.lit(0)))
    pct = 100.0 * F.col("n") / F.greatest("total", F.lit(1))
    needed = F.greatest(F.lit(1), (F.floor(F.col("total") * F.col("least") / 100) - F.col("n")))
    return d.select("era", "n", F.round(pct, 1).alias("pct"), F.when(pct < F.col("least"), "under").when(pct > F.col("most"), "over").otherwise("ok").alias("status"), F.when(pct < F.col("least"), needed).otherwise(0).cast("long").alias("needed"))


def health(papers: DataFrame) -> DataFrame:
    """One row: all, seeds, with and without text, by layer; one pass."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return papers.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_seed")).alias("seeds"), F.count_if(~blank("full_text")).alias("with_text"), F.count_if(blank("full_text")).alias("without_text"),
        F.count_if(blank("title")).alias("blank_titles"), F.count_if(blank("abstract")).alias("blank_abstracts"), *[F.count_if(F.col("layer") == x).alias(f"layer_{x}") for x in ("prerequisite", "foundation", "core", "latest")],
    )


def latency(d: DataFrame, value: str, *by: str) -> DataFrame:
    """count, avg, p50, p95, p99 (interpolated) and max; no group is gathered in one task."""
    a = d.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("avg_ms"), F.round(F.max(value), 1).alias("max_ms"))
    q = quantiles.interpolated(d, value, list(by), {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    q = q.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.round(c, 1).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")])
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(q[f"__{c}"]) for c in by], F.lit(True))
    return a.join(q, same, "left").select(*by, "n", "avg_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")


def p95_by_index(d: DataFrame, value: str, *by: str) -> DataFrame:
    """The value at place int(0.95 n) in order, without gathering a group."""
    found = quantiles.placed(d, value, list(by), {"p95_ms": F.floor(F.col("n") * 0.95)})
    return found.select(*by, F.round("p95_ms", 1).alias("p95_ms"))


def cache_impact(d: DataFrame, value: str, hit: str, *by: str) -> DataFrame:
    avg = lambda on: F.avg(F.when(on, F.col(value)))
    a = d.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"), avg(F.col(hit)).alias("h"), avg(~F.col(hit)).alias("m"))
    saved = F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0)) - F.coalesce("h", F.lit(0.0)))
    return a.select(*by, "hits", "misses", F.round("h", 1).alias("hit_ms"), F.round("m", 1).alias("miss_ms"), F.round(saved, 1).alias("reduction_ms"), F.round(saved * F.col("hits"), 1).alias("saved_ms"))


def gap_fill(gaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each era that lacks papers, as many relevant candidates of its years, latest first."""
    d = candidates.withColumn("era", era_of(F.year("published"))).join(F.broadcast(gaps.select("era", "needed")), "era")
    w = Window.partitionBy("era").orderBy(F.desc("published"), "paper_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("needed")).select("era", "paper_id", "published", "rank")


def _let_in(layers: list, frees: list[bool], count: dict, total: int, shares: dict[str, float]) -> tuple[list[int], list[int], int]:
    """Takes a block of arrivals in order; ``count`` changes."""
    taken, totals = [], []
    for i, (layer, free) in enumerate(zip(layers, frees, strict=True)):
        n = count.get(layer, 0)
        if free or layer not in shares or n / max(total, 1) < shares[layer] or n % 3 == 0:
            count[layer], total = n + 1, total + 1
            taken.append(i)
            totals.append(total)
    return taken, totals, total


def _columns(t: pa.Table) -> tuple[list, list]:
    return t.column("layer").to_pylist(), t.column("free").to_pylist()


#: Arrivals of a block; blocks are simulated at once.
QUOTA_BLOCK = 200_000


def quota(arrivals: DataFrame, shares: dict[str, float] = config.LAYER_SHARES, key: str = "paper_id", held: dict[str, int] | None = None, free: str | None = None, block: int = QUOTA_BLOCK) -> DataFrame:
    """(key, layer, total): arrivals that are let in, in order of the key, and how many papers
    there are then.  A layer whose share of the corpus has reached its quota is throttled: one
    of its papers comes in only while their number is a multiple of three.  The corpus holds
    ``held`` papers of each layer before; where the column ``free`` is true, a paper always comes in.

    Each decision depends on all before it through a few counters alone.  So arrivals are
    dealt in order into blocks, all blocks run at once from guessed counters, and those run
    again whose guess isn't what the block before ended with.  Runs that start from different
    counters meet once the quota binds, so a few rounds settle all; each settles one block at
    least.  What comes to the driver is a handful of counters a block.  Ties of the key are
    dealt by layer; unthrottled layers are counted as one."""
    first = {k: n for k, n in (held or {}).items()}
    spark, kind = arrivals.sparkSession, arrivals.schema[key].dataType.simpleString()
    n = arrivals.count()
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, layer string, total long")
    always = F.lit(False) if free is None else F.coalesce(F.col(free), F.lit(False))
    d = arrivals.select(key, F.col("layer").cast("string").alias("layer"), always.alias("free"), F.monotonically_increasing_id().alias("__row"))
    d = d.repartitionByRange(-(-n // block), F.asc(key), F.asc("layer"), F.asc("__row"))
    d = stored(d.sortWithinPartitions(key, "layer", "__row").withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("__row"), "arrivals")

    def counters(count: dict, total: int) -> tuple[int, ...]:
        return (*(count.get(x, 0) for x in shares), total)

    def ends(starts: dict[int, tuple[int, ...]]):
        def run(k: tuple, t: pa.Table) -> pa.Table:
            start = starts[k[0].as_py()]
            count = dict(zip(shares, start[:-1], strict=True))
            _, _, total = _let_in(*_columns(t.sort_by("place")), count, start[-1], shares)
            return pa.table({"block": pa.array([k[0].as_py()], pa.int32()), "ends": pa.array([counters(count, total)], pa.list_(pa.int64()))})

        return run

    blocks = sorted(r[0] for r in d.select("block").distinct().collect())
    start = counters(first, sum(first.values()))
    guesses, done = dict.fromkeys(blocks, start), {}
    todo = blocks
    while todo:
        asked = d.where(F.col("block").isin(todo)).select("block", "layer", "free", "place")
        done |= {r["block"]: (guesses[r["block"]], tuple(r["ends"])) for r in asked.groupBy("block").applyInArrow(ends({b: guesses[b] for b in todo}), "block int, ends array<long>").collect()}
        now, todo = start, []
        for b in blocks:
            was, end = done[b]
            if was != now:
                guesses[b] = now
                todo.append(b)
            # The block is taken to add as much as it did from the guess.
            now = tuple(x + e - w for x, e, w in zip(now, end, was, strict=True))
    last = {b: done[b][0] for b in blocks}

    def let_in(k: tuple, t: pa.Table) -> pa.Table:
        t, at = t.sort_by("place"), last[k[0].as_py()]
        taken, totals, _ = _let_in(*_columns(t), dict(zip(shares, at[:-1], strict=True)), at[-1], shares)
        return t.select([key, "layer"]).take(pa.array(taken, pa.int64())).append_column("total", pa.array(totals, pa.int64()))

    return d.groupBy("block").applyInArrow(let_in, f"`{key}` {kind}, layer string, total long")


def result_analytics(d: DataFrame, most: int = 5) -> DataFrame:
    """(qid, kind, name, n): the commonest authors and categories, layers, and distinct papers."""
    names = lambda c, kind: d.select("qid", F.lit(kind).alias("kind"), F.explode(F.split(F.coalesce(c, F.lit("")), r",\s*")).alias("name")).where("name <> ''")
    both = names("authors", "author").unionByName(names("categories", "category")).groupBy("qid", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("qid", "kind").orderBy(F.desc("n"), "name")
    both = both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    layers = d.groupBy("qid", F.lit("layer").alias("kind"), F.col("layer").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    papers = d.groupBy("qid").agg(F.lit("papers").alias("kind"), F.lit("unique").alias("name"), F.count_distinct("paper_id").alias("n"))
    return both.unionByName(layers).unionByName(papers.select("qid", "kind", "name", "n"))


def metrics(found: DataFrame, relevant: DataFrame, questions: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(qid, recall@k, precision@k, ndcg@k..., mrr) of ranked (qid, doc_id, rank) against (qid, doc_id)."""
    hits = found.join(relevant.select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    gains = []
    for k in cutoffs:
        on = F.col("rank") <= k
        gains += [F.sum(F.when(on, 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when(on, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"g{k}")]
    h = hits.groupBy("qid").agg(*gains, F.min("rank").alias("first"))
    n = relevant.select("qid", "doc_id").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    d = questions.select("qid").join(h, "qid", "left").join(n, "qid", "left").fillna(0)
    out = []
    for k in cutoffs:
        ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n").cast("int")))), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
        safe = lambda a, b: F.round(F.coalesce(F.when(F.col("n") > 0, a / b), F.lit(0.0)), 6)
        out += [safe(F.col(f"h{k}"), F.col("n")).alias(f"recall_{k}"), F.round(F.col(f"h{k}") / F.lit(float(k)), 6).alias(f"precision_{k}"), safe(F.col(f"g{k}"), ideal).alias(f"ndcg_{k}")]
    return d.select("qid", *out, F.round(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"))


def averages(d: DataFrame, by: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Averages by group and over all (a null group), in one pass of grouping sets."""
    return d.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in columns])


ERAS = config.ERAS
