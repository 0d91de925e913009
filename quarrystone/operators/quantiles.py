"""Exact order statistics of groups of any size by refined histograms.

No group is ever gathered or sorted in one task: each pass counts, with partial sums before the
shuffle, how many of a group's values fall into the bins of the intervals that still hold a wanted
place, and keeps only the bin that holds it.  As bins shrink to the least and largest value in
them, ties end at once, and three or four passes of 1024 bins are usual.  Bins are even, or even
in the logarithm where an interval holds both signs or a wide range, so that some nine passes
use up the bits of any doubles.

Nulls and NaNs count for nothing; a group without values has null quantiles; a null group is a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.shared import dropped, stored

BINS = 1024
#: Intervals that are broadcast: their number follows the groups, so it is counted first.
BROADCAST_ROWS = 100_000


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[f"a_{n}"].eqNullSafe(b[f"b_{n}"]) for n in names], F.lit(True))


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where a value lies between the ends of its interval, from 0 to 1, never falling."""
    scale = lambda x: F.signum(x) * F.when(x == 0, 0.0).otherwise(F.least(F.log2(F.abs(x)), F.lit(1100.0)) + 1100)
    near = (F.signum(lo) == F.signum(hi)) & (lo != 0) & (F.greatest(F.abs(lo), F.abs(hi)) / 4 <= F.least(F.abs(lo), F.abs(hi)))
    return F.when(near, (v - lo) / (hi - lo)).otherwise((scale(v) - scale(lo)) / (scale(hi) - scale(lo)))


def placed(d: DataFrame, value: str, by: list[str], places: dict[str, Column]) -> DataFrame:
    """(by, n, each name): for each group the values at the places, from 0, that expressions of
    ``n``, the number of its values, name; a place beyond the last is the last."""
    v = F.col(value).cast("double")
    rows = d.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(f"a_{c}") for c in by], v.alias("v"))
    held = [F.col(f"a_{c}").alias(f"b_{c}") for c in by]
    sizes = rows.groupBy(*[f"a_{c}" for c in by]).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = stored(sizes.select(*held, "n", "lo", "hi").where("n > 0"), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(place, F.col("n") - 1)).cast("long").alias("k")) for name, place in places.items()])).alias("x")
    wanted = stored(sizes.select(*[f"b_{c}" for c in by], "lo", "hi", each).select(*[f"b_{c}" for c in by], "lo", "hi", "x.name", "x.k"), "wanted")
    keys = [f"b_{c}" for c in by]
    while n := (open_ := wanted.where("lo < hi").select(*keys, "lo", "hi").distinct()).count():
        found = rows.join(F.broadcast(open_) if n <= BROADCAST_ROWS else open_, _same(rows, open_, by) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bins = found.groupBy(*keys, "lo", "hi", F.least(F.floor(_share(F.col("v"), F.col("lo"), F.col("hi")) * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("m").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
        b = bins.select(*[F.col(c).alias(c.replace("b_", "a_", 1)) for c in keys], F.col("lo").alias("l"), F.col("hi").alias("h"), "m", "least", "most", "before")
        on = _same(b, wanted, by) & (F.col("l") == F.col("lo")) & (F.col("h") == F.col("hi")) & (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("m"))
        new = wanted.where("lo < hi").join(b, on).select(*keys, F.col("least").alias("lo"), F.col("most").alias("hi"), "name", (F.col("k") - F.col("before")).alias("k"))
        was, wanted = wanted, stored(new.unionByName(wanted.where("lo >= hi")), "wanted")
        dropped(was)
    picked = wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in places])
    all_ = sizes.select(*[F.col(c).alias(c.replace("b_", "a_", 1)) for c in keys], "n")
    return all_.join(picked, _same(all_, picked, by)).select(*[F.col(c).alias(c[2:]) for c in keys], "n", *places)


def interpolated(d: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, n, each name): quantiles, interpolated between the two nearest values."""
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    d = placed(d, value, by, {f"{name}{end}": f(x).cast("long") for name, x in at.items() for end, f in (("_lo", F.floor), ("_hi", F.ceil))})
    part = lambda name: (at[name] - F.floor(at[name])) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
    return d.select(*by, "n", *[(F.col(f"{name}_lo") + part(name)).alias(name) for name in shares])
