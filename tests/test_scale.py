"""Reports without one task for a group, against plain-Python twins."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import quantiles, reports


def test_quantiles_of_hot_ties_and_extremes(spark, monkeypatch):
    r = random.Random(4)
    groups = {
        "ties": [5.0] * 900 + [7.0] * 100, "one": [3.25], "wide": [r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300) for _ in range(500)], "edge": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-320],
        None: [float(k) for k in range(777)], "even": [r.random() for _ in range(2048)], "odd": [None, float("nan"), 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(quantiles, "BINS", 31)
    shares = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {x["g"]: x for x in quantiles.interpolated(d, "v", ["g"], shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and not math.isnan(v))
        assert got[g]["n"] == len(vs)
        for name, q in shares.items():
            if g != "edge" or q in (0.0, 1.0):
                assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=0)
    places = {x["g"]: x["k"] for x in quantiles.placed(d, "v", ["g"], {"k": F.floor(F.col("n") * 0.95)}).collect()}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and not math.isnan(v))
        assert places[g] == vs[min(int(len(vs) * 0.95), len(vs) - 1)]
    whole = quantiles.interpolated(d.where("g = 'even'"), "v", [], {"p50": 0.5}).first()
    assert whole["p50"] == pytest.approx(float(np.median(groups["even"])))
    assert quantiles.interpolated(d.limit(0), "v", ["g"], shares).count() == 0


def test_quantile_plans_gather_no_group(spark):
    """Neither a percentile nor a window over the rows: windows stand on counted bins alone."""
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    for made in (reports.latency(d, "v", "g"), reports.p95_by_index(d, "v", "g")):
        plan = made._jdf.queryExecution().toString()
        assert "percentile" not in plan and "Window" not in plan


def admitted_by_hand(rows, shares, held):
    count, total, out = dict(held), sum(held.values()), []
    for key, layer in rows:
        n = count.get(layer, 0)
        if layer not in shares or n / max(total, 1) < shares[layer] or n % 3 == 0:
            count[layer], total = n + 1, total + 1
            out.append((key, layer, total))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_quota_in_blocks(spark, seed):
    """Blocks of any start give what one pass gives, layers that are null or come in bursts too."""
    r = random.Random(seed)
    layers = ["latest", "core", "foundation", "prerequisite", None]
    rows = [(k, r.choices(layers, [9, 4, 1, 1, 0.2] if (k // 300) % 2 else [1, 6, 2, 1, 0])[0]) for k in range(3000)]
    held = {} if seed else {"latest": 50, "core": 3}
    mixed = rows[:]
    r.shuffle(mixed)
    got = reports.quota(spark.createDataFrame(mixed, "paper_id long, layer string"), held=held, block=170)
    assert sorted(map(tuple, got.collect())) == admitted_by_hand(rows, reports.config.LAYER_SHARES, held)
    assert reports.quota(spark.createDataFrame([], "paper_id long, layer string")).count() == 0


def test_quota_rounds_are_few(spark):
    """Twenty blocks settle in a few rounds, far fewer than blocks: few jobs in all."""
    rows = [(k, ["latest", "core", "latest", "foundation"][k % 4]) for k in range(4000)]
    d = spark.createDataFrame(rows, "paper_id long, layer string")
    sc = spark.sparkContext
    sc.setJobGroup("quota", "rounds")
    try:
        got = reports.quota(d, block=200)
        jobs = len(sc.statusTracker().getJobIdsForGroup("quota"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 25
    assert sorted(map(tuple, got.collect())) == admitted_by_hand(rows, reports.config.LAYER_SHARES, {})
