"""A crawl over saved pages that is lost and goes on."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import paged


def saved(root, first: int, n: int, broken=()):
    os.makedirs(root, exist_ok=True)
    for p in range(first, first + n):
        with open(f"{root}/page-{p:05}.json", "w") as f:
            f.write("[{" if p in broken else json.dumps([{"id": 10 * p + k} for k in range(p % 4)]))


def taken(rows):
    return rows.select("page", F.get_json_object("json", "$.id").cast("long").alias("id"))


def ids(spark, out):
    return sorted(r["id"] for r in spark.read.parquet(f"{out}/records").collect())


def want(pages):
    return sorted(10 * p + k for p in pages for k in range(p % 4))


def test_a_lost_crawl_resumes_without_gaps_or_doubles(spark, tmp_path):
    root, out, at = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/state"
    saved(root, 0, 13, broken={5})
    calls = []

    def dies(rows):
        calls.append(1)
        if len(calls) == 1:
            taken(rows).limit(2).write.parquet(f"{out}/records/batch=0")  # half of it is there already
            raise RuntimeError("lost")
        return taken(rows)

    with pytest.raises(Exception, match="lost"):
        paged.crawl(spark, root, out, at, dies, pages_per_batch=4)
    paged.crawl(spark, root, out, at, dies, pages_per_batch=4)
    assert ids(spark, out) == want(set(range(13)) - {5})
    saved(root, 13, 4)
    paged.crawl(spark, root, out, at, taken, pages_per_batch=2)
    assert ids(spark, out) == want(set(range(17)) - {5})
    paged.crawl(spark, root, out, at, taken)  # nothing new
    assert ids(spark, out) == want(set(range(17)) - {5})
    assert [r["page"] for r in paged.failed(spark, out).collect()] == ["page-00005.json"]
    assert paged.retried(spark, root, out, taken) == 0
    saved(root, 5, 1)
    assert paged.retried(spark, root, out, taken) == 1
    assert ids(spark, out) == want(range(17)) and paged.failed(spark, out).count() == 0
    assert paged.retried(spark, root, out, taken) == 0


def test_pages_as_a_table(spark, tmp_path):
    spark.dataSource.register(paged.SavedPages)
    saved(f"{tmp_path}/p", 0, 5, broken={2})
    d = spark.read.format("saved_pages").option("path", f"{tmp_path}/p").load()
    assert sorted((r["page"][5:10], r["position"]) for r in d.where("error is null").collect()) == sorted((f"{p:05}", k) for p in (1, 3) for k in range(p % 4))
    assert d.where("error is not null").count() == 1
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("saved_pages").option("path", f"{tmp_path}/none").load().count() == 0
