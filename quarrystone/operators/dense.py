"""Exact nearest neighbours of many questions: blocks of vectors against all questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the questions' matrix that are broadcast at once; more questions take more passes.
MOST_NUMBERS = 32_000_000
#: Rows (score, key) that a worker keeps at once, for all questions of a pass.
MOST_KEPT = 8_000_000
BLOCK = 4096
#: Questions that a block is multiplied with at once.
ASKED = 512


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def normalized(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then by key."""
    if len(scores) > k:
        on = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, keys = scores[on], keys[on]
    order = np.lexsort((keys, -scores))[:k]
    return scores[order], keys[order]


def top(vectors: DataFrame, questions: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", question: str = "vector", cosine: bool = False, digits: int = 6, own: str | None = None) -> DataFrame:
    """(qid, key, score, rank).  Filter ``vectors`` before: this ranks what it is given, but for
    vectors whose column ``own`` is the question's id, which are left out before they are ranked.

    Each task keeps the k best of all its vectors for each question, so what is shuffled
    follows the tasks, not the vectors.  Questions are counted before any is fetched and go
    to the workers in as many passes as their bound asks for."""
    asked = questions.select(qid, question).where(F.col(question).isNotNull())
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(question)), F.lit(0))).first()
    passes = max(1, -(-n * size // MOST_NUMBERS), -(-n * k // MOST_KEPT))
    part = None
    for one in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(qid), F.lit(passes)) == one)
        more = _pass(vectors, some, k, key, vector, qid, cosine, digits, own)
        part = more if part is None else part.unionByName(more)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "k")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("k", key)


def _pass(vectors: DataFrame, questions: DataFrame, k: int, key: str, vector: str, qid: str, cosine: bool, digits: int, own: str | None) -> DataFrame:
    rows = questions.toArrow()
    q = _matrix(rows.column(1).combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), normalized(q) if cosine and q.size else q))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, against = shared.value
        held: list = [None] * len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column("v"))
                x = normalized(x) if cosine else x
                keys = batch.column("k").to_numpy()
                of = batch.column("own").to_numpy() if own else None
                for first in range(0, len(ids), ASKED):
                    s = np.round(x @ against[first : first + ASKED].T, digits)
                    for j in range(s.shape[1]):
                        on = slice(None) if of is None else of != ids[first + j]
                        best = _best(s[on, j], keys[on], k)
                        was = held[first + j]
                        held[first + j] = best if was is None else _best(np.concatenate([was[0], best[0]]), np.concatenate([was[1], best[1]]), k)
        for first in range(0, len(ids), ASKED):
            some = [(i, *h) for i, h in zip(ids[first : first + ASKED], held[first : first + ASKED], strict=True) if h is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([i for i, _, _ in some], [len(s) for _, s, _ in some])), pa.array(np.concatenate([y for _, _, y in some])), pa.array(np.concatenate([s for _, s, _ in some]))], ["qid", "k", "score"])

    kind = questions.schema[qid].dataType.simpleString()
    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), *([F.col(own).alias("own")] if own else [])).mapInArrow(blocks, f"qid {kind}, k {kinds[key]}, score double")


def top_within(vectors: DataFrame, questions: DataFrame, k: int, *, group: str, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", question: str = "vector", digits: int = 6) -> DataFrame:
    """(qid, group, key, score, rank): the k best of each question within each group it asks for.

    ``questions`` has a row for each question and group; groups are longs.  As in ``top``,
    a task keeps the k best of its own vectors for each of these rows, so a large group is
    many tasks' work and none of its pairs with questions is ever a row."""
    asked = questions.select(F.col(qid).alias("qid"), F.col(group).cast("long").alias("g"), F.col(question).alias("v")).where("v is not null and g is not null")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    passes = max(1, -(-n * size // MOST_NUMBERS), -(-n * k // MOST_KEPT))
    part = None
    for one in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("qid", "g"), F.lit(passes)) == one)
        more = _pass_within(vectors, some, k, group, key, vector, digits)
        part = more if part is None else part.unionByName(more)
    w = Window.partitionBy("qid", "g").orderBy(F.desc("score"), "k")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnsRenamed({"k": key, "g": group})


def _pass_within(vectors: DataFrame, questions: DataFrame, k: int, group: str, key: str, vector: str, digits: int) -> DataFrame:
    rows = questions.toArrow().sort_by("g")
    q = _matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    groups, first = np.unique(rows.column("g").to_numpy(), return_index=True)
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column("qid").to_numpy(), groups, np.append(first, rows.num_rows), q))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, first, against = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, BLOCK):
                batch = whole.slice(at, BLOCK)
                g = batch.column("g").to_numpy()
                of = np.minimum(np.searchsorted(groups, g), len(groups) - 1)
                on = np.flatnonzero(groups[of] == g)
                if not len(on):
                    continue
                on = on[np.argsort(of[on], kind="stable")]
                x, keys = _matrix(batch.column("v"))[on], batch.column("k").to_numpy()[on]
                here, start = np.unique(of[on], return_index=True)
                for i, a, b in zip(here, start, np.append(start[1:], len(on)), strict=True):
                    for j in range(first[i], first[i + 1]):
                        best = _best(np.round(x[a:b] @ against[j], digits), keys[a:b], k)
                        was = held.get(j)
                        held[j] = best if was is None else _best(np.concatenate([was[0], best[0]]), np.concatenate([was[1], best[1]]), k)
        rows = sorted(held)
        of_row = np.searchsorted(first, rows, side="right") - 1
        for at in range(0, len(rows), ASKED):
            some = [held[j] for j in rows[at : at + ASKED]]
            n = [len(s) for s, _ in some]
            columns = [np.repeat(ids[rows[at : at + ASKED]], n), np.repeat(groups[of_row[at : at + ASKED]], n), np.concatenate([y for _, y in some]), np.concatenate([s for s, _ in some])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "g", "k", "score"])

    d = vectors.where(F.col(vector).isNotNull() & F.col(group).isNotNull())
    kind = questions.schema["qid"].dataType.simpleString()
    return d.select(F.col(group).cast("long").alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(blocks, f"qid {kind}, g long, k {kinds[key]}, score double")


def best_variant(found: DataFrame, key: str, most: int) -> DataFrame:
    """Over variants, each key's best score; the best ``most`` again."""
    best = found.groupBy("qid", key).agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, vector): the mean of a group's vectors, of length one (null vectors don't count); a
    task hands on one vector for each of its groups."""
    each = vectors.where(F.col(vector).isNotNull()).select(group, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    mean = each.groupBy(group).agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("x"))
    norm = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return mean.withColumn("norm", norm).select(group, F.transform("x", lambda x: x / F.col("norm")).alias("vector"))


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds scale and int8 codes: x is about code * scale."""
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x))) / 127.0
    return vectors.withColumn("scale", scale).withColumn("codes", F.transform(vector, lambda x: F.round(x / F.greatest(F.col("scale"), F.lit(1e-12))).cast("tinyint")))
