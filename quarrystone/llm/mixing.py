"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``alpha``, normalised.
``alpha`` is found by bisection on [0, 1] (many points of the interval are
tried in one pass over the source totals): the smallest that keeps every source
within ``most_repeats`` passes, or the one that meets ``entropy`` (in nats).
Each source then gets its share of ``budget`` tokens as whole passes over its
documents and a part of one more: blocks of documents, in an order drawn anew for
each pass, until the budget is met; the last block is cut between documents.
Without a budget, the mix is as large as gives the least repeated source one
whole pass, so that no document is lost.

A target that no exponent meets is an error that tells what can be met.

Defined results: a null source is a source of its own; a null or empty text has
no tokens; a source without tokens gets one pass; rows with equal ids take the
same place in the order; an empty input gives an empty mix; all columns of the
input come back; texts of any length count whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import ROW, stored, words_of

#: Sources up to this many are broadcast by hint; beyond, Spark chooses the join.
BROADCAST_SOURCES = 10_000
#: Most blocks of a source; they become larger, not more, as it grows.
MOST_BLOCKS = 4096
BLOCK_ROWS = 64


@dataclass(frozen=True)
class Target:
    #: Tokens of the mix over tokens of the corpus; None: what gives every document once at least.
    budget: float | None = None
    most_repeats: float | None = None
    entropy: float | None = None
    seed: int = 17


def _source(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def _figures(totals: DataFrame, alphas: list[float]) -> list[tuple[float, float, float, float]]:
    """(alpha, entropy, largest and least of weight over tokens) for each alpha."""
    d = totals.where("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(a) for a in alphas])))
    p = F.exp(F.col("a") * F.log("share"))
    r = d.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.log("share")).alias("s"), F.max(p / F.col("tokens")).alias("most"), F.min(p / F.col("tokens")).alias("least"))
    rows = r.select("a", (F.log("z") - F.col("a") * F.col("s") / F.col("z")), F.col("most") / F.col("z"), F.col("least") / F.col("z"), "z").collect()
    return sorted(tuple(x) for x in rows)


def find_alpha(totals: DataFrame, target: Target, *, points: int = 32, digits: int = 9) -> tuple[float, float, float]:
    """(alpha, z, budget): narrows [0, 1] ``points`` fold a round until ``digits`` are known."""
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0

    def enough(x) -> bool:
        """True from the wanted alpha on."""
        if target.entropy is not None:
            return x[1] <= target.entropy
        if target.most_repeats is None:
            return x[0] >= 1.0
        budget = target.budget * all_tokens if target.budget is not None else 1 / x[3]
        return budget * x[2] <= target.most_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    while True:
        tried = _figures(totals, [low + (high - low) * k / points for k in range(points + 1)])
        if not tried:
            return 1.0, 1.0, float(all_tokens)
        k = next((k for k, x in enumerate(tried) if enough(x)), None)
        if k is None or (k == 0 and low == 0 and target.entropy is not None and tried[0][1] < target.entropy - 1e-9):
            raise ValueError(_unmet(target, tried, all_tokens))
        low, high, at = tried[max(0, k - 1)][0], tried[k][0], tried[k]
        if k == 0 or high - low < 10**-digits:
            return at[0], at[4], target.budget * all_tokens if target.budget is not None else 1 / at[3]


def _unmet(target: Target, tried: list[tuple[float, float, float, float]], all_tokens: int) -> str:
    if target.entropy is not None:
        return f"no exponent in [0, 1] gives an entropy of {target.entropy}: they give {tried[-1][1]:.6g} to {tried[0][1]:.6g}"
    least = target.budget * all_tokens * tried[-1][2] if target.budget is not None else tried[-1][2] / tried[-1][3]
    return f"no exponent in [0, 1] keeps all sources within {target.most_repeats} passes: {least:.6g} is the least"


def _places(seed: int, doc_id: str) -> tuple[Column, Column]:
    """A document's block within its source, and its place within the block."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id))
    return F.pmod(h, F.col("blocks")), F.xxhash64(F.lit(seed + 1), F.col(doc_id))


def plan(slim: DataFrame, target: Target) -> DataFrame:
    """From stored (src, tokens, id): a row per source with passes, the number of whole
    ones, and cut_block and cut_place, up to where the last pass goes."""
    totals = slim.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    totals = stored(totals, "totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    alpha, z, budget = find_alpha(totals, target)
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(alpha) * F.log("share")) / F.lit(z)).otherwise(0.0)
    due = F.round(F.lit(float(budget)) * F.col("weight")).cast("long")
    p = totals.withColumn("weight", weight).withColumn("due", due)
    p = p.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("due") / F.col("tokens"))).otherwise(1).cast("long"))
    p = p.withColumn("rest", F.when(F.col("tokens") > 0, F.col("due") - F.col("passes") * F.col("tokens")).otherwise(0))
    p = p.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(F.col("n") / BLOCK_ROWS))).cast("long"))
    p = stored(p, "plan")
    of = slim.join(_small(p.select("src", "passes", "blocks", "rest")), "src").where("rest > 0")
    block, place = _places(target.seed, "id")
    of = of.select("src", "tokens", "rest", _order(target.seed, F.col("passes"), block).alias("at"), place.alias("place"))
    sums = of.groupBy("src", "at").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    w = Window.partitionBy("src").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("till", F.sum("tokens").over(w))
    cut = sums.where((F.col("till") > F.col("rest")) & (F.col("till") - F.col("tokens") <= F.col("rest")))
    cut = cut.select(F.col("src").alias("cut_src"), F.col("at").alias("cut_block"), (F.col("rest") - F.col("till") + F.col("tokens")).alias("left"))
    inside = of.join(_small(cut), (F.col("src") == F.col("cut_src")) & (F.col("at") == F.col("cut_block"))).groupBy("cut_src", "cut_block", "left", "place").agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy("cut_src").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("till", F.sum("tokens").over(w)).groupBy("cut_src", "cut_block").agg(F.max(F.when(F.col("till") <= F.col("left"), F.col("place"))).alias("cut_place"))
    return stored(p.join(inside, F.col("src") == F.col("cut_src"), "left").drop("cut_src"), "cuts")


def _order(seed: int, epoch: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(seed + 2), epoch.cast("long"), block.cast("long"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, target: Target, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``ROW`` (the input row) once for each pass that takes it, with mix_source, epoch and mix_block."""
    slim = docs.select(_source(source).alias("src"), F.size(words_of(F.col(text))).cast("long").alias("tokens"), F.col(doc_id).alias("id"))
    return _realised(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), _source(source).alias("src"), F.col(doc_id).alias("id")), stored(slim, "tokens"), target)


def mix_tokens(docs: DataFrame, target: Target, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix without texts: doc_id, source, n_tokens, epoch, mix_block, weight; texts are read once."""
    slim = stored(docs.select(F.col(source).cast("string").alias("source"), _source(source).alias("src"), F.size(words_of(F.col(text))).cast("long").alias("tokens"), F.col(doc_id).alias("id")), "tokens")
    out = _realised(slim, slim.drop("source"), target)
    return out.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "epoch", "mix_block", "weight")


def _realised(rows: DataFrame, slim: DataFrame, target: Target) -> DataFrame:
    p = plan(slim, target).select("src", "passes", "blocks", "rest", "cut_block", "cut_place", "weight")
    d = rows.join(_small(p), "src")
    block, place = _places(target.seed, "id")
    d = d.withColumns({"mix_block": block, "place": place})
    at = _order(target.seed, F.col("passes"), F.col("mix_block"))
    last = (F.col("rest") > 0) & (F.col("cut_block").isNull() | (at < F.col("cut_block")) | ((at == F.col("cut_block")) & (F.col("place") <= F.col("cut_place"))))
    copies = F.col("passes") + F.when(F.coalesce(last, F.lit(False)), 1).otherwise(0)
    d = d.withColumn("copies", copies.cast("int")).where("copies > 0")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return d.drop("passes", "blocks", "rest", "cut_block", "cut_place", "place", "copies")
