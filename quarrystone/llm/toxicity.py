"""Toxicity: subword-bag embeddings averaged into a linear softmax, in numpy.

A word is the mean of the embeddings of its character n-grams and itself (hashed
into buckets), a document the mean of its words, and a softmax over two classes
reads it; embeddings and softmax are trained jointly.  As all of it is linear up to
the softmax, scoring needs one number per bucket, which is what workers get.

Defined results: a null or empty text has no words and scores the bias alone;
null labels are ignored; with labels of one class only, every text scores the
share of that class, bounded away from 0 and 1; rows are scored each for itself;
texts of any length count whole; a score of exactly 0.5 counts as label 1 in the query; an empty
table gives no rows; only the named columns of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import dropped, stored
from quarrystone.llm.hashing import subwords

EDGES = b".,;:!?\"'()[]{}#*$%&|<>-_/"
#: A document's mean is scaled by this, as what counts is a small part of its words.
SCALE = 50.0


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dimensions: int = 8
    least: int = 3
    most: int = 6
    steps: int = 90
    rate: float = 0.1
    #: Part of the embeddings lost in each step.
    decay: float = 0.002
    #: Least scale of a step, as a part of the largest gradient.
    floor: float = 0.004
    #: A word trains its n-grams if it is in so many documents of the sample.
    documents: int = 3
    seed: int = 3


@dataclass(frozen=True)
class Model:
    """A text's score is sigmoid(bias + SCALE * mean over words of the mean over buckets)."""

    buckets: np.ndarray
    bias: float
    settings: Settings

    def words(self, words: list[bytes]) -> np.ndarray:
        s = self.settings
        at, offsets = subwords([w.strip(EDGES) for w in words], s.least, s.most, s.buckets)
        if not words:
            return np.zeros(0)
        return np.add.reduceat(self.buckets[at].astype(np.float64), offsets[:-1]) / np.diff(offsets)


def _bags(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and (row, word, share of the row's words) of every pair."""
    index: dict[bytes, int] = {}
    row, col, share = [], [], []
    for k, t in enumerate(texts):
        ids = np.array([index.setdefault(w.strip(EDGES), len(index)) for w in t.lower().encode().split()], np.int64)
        u, n = np.unique(ids, return_counts=True)
        row.append(np.full(len(u), k, np.int32))
        col.append(u.astype(np.int32))
        share.append((n / max(1, len(ids))).astype(np.float32))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return list(index), cat(row, np.int32), cat(col, np.int32), cat(share, np.float32)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, settings: Settings = Settings()) -> Model:
    """Full-batch Adam on the weighted cross entropy of embeddings and softmax together.
    A floor under its scale, a part of the largest gradient, keeps what few documents
    share from weighing like what many share."""
    s = settings
    y = np.asarray(labels, np.float64)
    wt = np.ones(len(y)) if weights is None else np.asarray(weights, np.float64)
    prior = float(np.clip((wt * y).sum() / max(1e-9, wt.sum()), 0.01, 0.99)) if len(y) else 0.5
    bias = np.array([0.0, np.log(prior / (1 - prior))])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), float(bias[1]), s)
    rng = np.random.default_rng(s.seed)
    words, row, col, share = _bags(texts)
    shared = np.bincount(col, minlength=len(words)) >= s.documents
    renumbered = np.cumsum(shared) - 1
    row, col, share = row[shared[col]], renumbered[col[shared[col]]], share[shared[col]]
    words = [w for w, on in zip(words, shared, strict=True) if on]
    if not words:
        return Model(np.zeros(s.buckets, np.float32), float(bias[1]), s)
    at, offsets = subwords(words, s.least, s.most, s.buckets)
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(words), dtype=np.int32), size)
    part = (1.0 / size).astype(np.float32)
    e = rng.normal(0, 0.01, (s.buckets, s.dimensions)).astype(np.float32)
    w = rng.normal(0, 0.5, (s.dimensions, 2)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, bias)]
    target = np.stack([1 - y, y], 1)
    wt = wt / wt.sum()
    for step in range(1, s.steps + 1):
        # Documents' logits need the embeddings through the softmax's columns only.
        g = e @ w
        z = np.stack([np.add.reduceat(g[at, c], offsets[:-1]) * part for c in (0, 1)], 1)
        logits = bias + SCALE * np.stack([np.bincount(row, z[col, c] * share, len(y)) for c in (0, 1)], 1)
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        d = (p - target) * wt[:, None]
        up = np.stack([np.bincount(col, d[row, c] * share, len(words)) for c in (0, 1)], 1) * (SCALE * part[:, None])
        b = np.stack([np.bincount(at, up[of, c], s.buckets) for c in (0, 1)], 1).astype(np.float32)
        grads = (b @ w.T, e.T @ b, d.sum(0))
        for x, grad, held in zip((e, w, bias), grads, state, strict=True):
            held[0] += 0.1 * (grad - held[0])
            held[1] += 0.01 * (grad * grad - held[1])
            x *= 1 - s.decay * (x is e)
            x -= s.rate / (1 - 0.9**step) * held[0] / (np.sqrt(held[1] / (1 - 0.99**step)) + s.floor * np.abs(grad).max() + 1e-12)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0]), s)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", learn: Column | None = None, max_rows: int = 6000, max_bytes: int = 24_000_000, settings: Settings = Settings()) -> Model:
    """Trains on a bounded sample of labelled documents, at most ``max_rows`` of them and
    about ``max_bytes`` of text, half of either class where there are as many, weighted
    back to the classes' shares.  Taken by id hash, of an id with several rows its smallest
    text; the driver gets no other text."""
    y = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    y = y.groupBy(F.col(doc_id).alias("__id")).agg((F.max(toxic) > 0).cast("int").alias("__y"))
    if learn is not None:
        y = y.where(learn)
    shares = {r[0]: r[1] for r in y.groupBy("__y").count().collect()}
    half = max_rows // 2
    y = y.where("__y = 1").orderBy(F.xxhash64("__id"), "__id").limit(half).unionByName(y.where("__y = 0").orderBy(F.xxhash64("__id"), "__id").limit(half))
    of = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    chosen = stored(of.join(F.broadcast(y), "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t")), "labelled")
    sizes = sorted(chosen.select(F.xxhash64("__id"), "__id", "__y", F.octet_length("__t")).collect())
    room, ids = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for _, i, c, n in sizes:
        if n <= room[c]:
            room[c] -= n
            ids.append((i,))
    keep = docs.sparkSession.createDataFrame(ids, chosen.select(F.col("__id").alias("__keep")).schema)
    rows = sorted(tuple(r) for r in chosen.join(F.broadcast(keep), F.col("__id") == F.col("__keep")).select("__id", "__y", "__t").collect())
    dropped(chosen)
    labels_ = np.array([r[1] for r in rows], int)
    taken = np.bincount(labels_, minlength=2)
    weights = np.array([shares.get(c, 0) / max(1, taken[c]) for c in labels_])
    return train([r[2] for r in rows], labels_, weights, settings)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", most_cached: int = 500_000) -> DataFrame:
    """doc_id, score of every document: one pass, nothing shuffled.  Workers keep the
    numbers of at most ``most_cached`` words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.bias, model.settings))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        known: dict[bytes, float] = {}
        for batch in batches:
            out = []
            for t in batch.column("t"):
                words = (t.as_py() or "").lower().encode().split()
                new = [w for w in set(words) if w not in known]
                if len(known) + len(new) > most_cached:
                    known.clear()
                    new = list(set(words))
                known.update(zip(new, m.words(new).tolist(), strict=True))
                x = m.bias + (SCALE * sum(map(known.__getitem__, words)) / len(words) if words else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(x, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(scored, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
