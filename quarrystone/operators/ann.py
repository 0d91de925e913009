"""Approximate nearest neighbours: inverted lists of int8 codes, probed, then ranked exactly.

Centroids are trained in numpy on a bounded sample; every vector is indexed, as a row (list, key,
scale, codes) beside the columns that filters need, sorted by list.  A question probes the lists of
the centroids nearest to it; how many is found on the sample, as the fewest lists that hold nearly
all true neighbours of some of its vectors.  Each task scans its rows of probed lists in blocks,
multiplies each with the questions that probe its list alone, and keeps the best candidates of
each question, so a list of any length is shared out among tasks.  Candidates meet the full
vectors last and are ranked by true scores, rounded and tied as in ``dense.top``.

Null vectors aren't indexed; of a key's repeated rows each is indexed; all-zero vectors score zero;
an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.dense import BLOCK, MOST_KEPT, MOST_NUMBERS, _best, _matrix, normalized

#: Vectors that centroids are trained on, at most; the driver holds them.
SAMPLE = 20_000
#: Lists, at most: their centroids go to every task.
MOST_LISTS = 4096
ROUNDS = 12
#: Candidates of a question for each row wanted.
WIDER = 4
#: Share of true neighbours that the probed lists must hold on the sample.
HELD = 0.97
#: Candidates that are broadcast; they are counted first.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray
    probes: int
    cosine: bool


def _sample(vectors: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """The vectors whose keys have the least hashes: the same for the same table."""
    d = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).alias("v"))
    return _matrix(d.orderBy("h").limit(most).select("v").toArrow().column(0).combine_chunks())


def _trained(x: np.ndarray, lists: int) -> np.ndarray:
    """Rounds of k-means by largest dot product less half the norm, from spread rows; empty lists start anew."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        of = np.concatenate([_nearest(x[a : a + BLOCK], c) for a in range(0, len(x), BLOCK)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(-n[of], kind="stable")[: len(empty)]] + 1e-9
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(1) / 2).argmax(1)


def _probed(q: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """For each question the lists to look into."""
    return np.argsort(-(q @ c.T - (c * c).sum(1) / 2), axis=1, kind="stable")[:, :probes]


def fit(vectors: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", cosine: bool = False, lists: int | None = None, sample: int = SAMPLE) -> Model:
    n = vectors.where(F.col(vector).isNotNull()).count()
    x = _sample(vectors, key, vector, sample)
    if not len(x):
        return Model(np.zeros((0, 0)), 0, cosine)
    x = normalized(x) if cosine else x
    lists = min(lists or max(1, int(2 * n**0.5)), MOST_LISTS, len(x))
    c = _trained(x, lists)
    asked = x[:: max(1, len(x) // 200)]
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : min(k, len(x))]
    of = _nearest(x, c)
    order = _probed(asked, c, lists)
    place = np.argsort(order, axis=1)  # of each list among a question's
    needed = np.sort(np.take_along_axis(place, of[true], 1).ravel())
    return Model(c, int(needed[min(len(needed) - 1, int(HELD * len(needed)))]) + 1, cosine)


def indexed(vectors: DataFrame, model: Model, path: str, *, key: str = "vec_id", vector: str = "embedding", attributes: tuple[str, ...] = ()) -> DataFrame:
    """Writes (list, key, scale, codes, attributes), by list, and returns it."""
    spark, names = vectors.sparkSession, [key, *attributes]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    shared = spark.sparkContext.broadcast((model.centroids, model.cosine))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cosine = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column("v"))
                x = normalized(x) if cosine else x
                scale = np.abs(x).max(1) / 127.0
                codes = np.rint(x / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, c).astype(np.int32)), pa.array(scale), pa.array([r.tobytes() for r in codes], pa.binary()), *(batch.column(n) for n in names)], ["list", "scale", "codes", *names])

    d = vectors.where(F.col(vector).isNotNull()).select(*names, F.col(vector).alias("v"))
    d = d.mapInArrow(coded, "list int, scale double, codes binary, " + ", ".join(f"`{n}` {kinds[n]}" for n in names))
    d.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def top(index: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, model: Model, *, keep: Column | None = None, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", question: str = "vector", digits: int = 6) -> DataFrame:
    """(qid, key, score, rank).  ``keep`` filters by attributes of the index before anything is ranked."""
    asked = questions.select(qid, question).where(F.col(question).isNotNull())
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(question)), F.lit(0))).first()
    passes = max(1, -(-n * size // MOST_NUMBERS), -(-n * WIDER * k // MOST_KEPT))
    rows = index if keep is None else index.where(keep)
    found = None
    for one in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(qid), F.lit(passes)) == one)
        more = _pass(rows, some, WIDER * k, model, key, qid)
        found = more if found is None else found.unionByName(more)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "k")
    best = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= WIDER * k).select("qid", "k").distinct()
    best = best.join(asked.select(F.col(qid).alias("qid"), F.col(question).alias("q")), "qid")
    full = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    d = full.join(F.broadcast(best) if n * WIDER * k <= BROADCAST_ROWS else best, "k")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot("v", "q")
    if model.cosine:
        score = score / F.greatest(F.sqrt(dot("v", "v")), F.lit(1e-12)) / F.greatest(F.sqrt(dot("q", "q")), F.lit(1e-12))
    d = d.select("qid", "k", F.round(score, digits).alias("score"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("k", key)


def _pass(rows: DataFrame, questions: DataFrame, most: int, model: Model, key: str, qid: str) -> DataFrame:
    asked = questions.toArrow()
    q = _matrix(asked.column(1).combine_chunks()) if asked.num_rows else np.zeros((0, 0))
    q = normalized(q) if model.cosine and q.size else q
    probed = _probed(q, model.centroids, model.probes) if q.size and model.probes else np.zeros((len(q), 0), int)
    by_list: dict[int, list[int]] = {}
    for i, lists in enumerate(probed.tolist()):
        for at in lists:
            by_list.setdefault(at, []).append(i)
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = spark.sparkContext.broadcast((asked.column(0).to_numpy(), q, {k: np.array(v) for k, v in by_list.items()}))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, against, lists = shared.value
        held: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of, keys = batch.column("list").to_numpy(), batch.column("k").to_numpy()
            x = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int8).reshape(batch.num_rows, -1)
            scale = batch.column("scale").to_numpy()
            for one in np.unique(of):
                if (who := lists.get(int(one))) is None:
                    continue
                on = np.flatnonzero(of == one)
                s = (x[on].astype(np.float32) @ against[who].T.astype(np.float32)) * scale[on, None]
                for j, i in enumerate(who.tolist()):
                    best = _best(s[:, j], keys[on], most)
                    was = held.get(i)
                    held[i] = best if was is None else _best(np.concatenate([was[0], best[0]]), np.concatenate([was[1], best[1]]), most)
        for i, (s, k) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + 1], len(s))), pa.array(k), pa.array(s.astype(np.float64))], ["qid", "k", "score"])

    kind = questions.schema[qid].dataType.simpleString()
    d = rows.select("list", F.col(key).alias("k"), "scale", "codes")
    if len(by_list) < len(model.centroids):  # whole row groups of other lists are passed over
        d = d.where(F.col("list").isin(sorted(by_list)))
    return d.mapInArrow(scanned, f"qid {kind}, k {kinds[key]}, score double")


def read_share(index: DataFrame, questions: DataFrame, model: Model, *, question: str = "vector") -> float:
    """Vectors that a question is held against, as a share of all, on average."""
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    q = _matrix(questions.select(question).where(F.col(question).isNotNull()).toArrow().column(0).combine_chunks())
    probed = _probed(normalized(q) if model.cosine else q, model.centroids, model.probes)
    return sum(sizes.get(int(x), 0) for x in probed.ravel()) / max(1, len(q) * sum(sizes.values()))
