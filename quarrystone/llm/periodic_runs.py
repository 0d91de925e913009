"""Stretches of words that repeat with a short period, found and collapsed.

A run is a stretch of words with smallest period q, at least ``least`` words and
``exponent`` times q long, that no neighbouring word extends.  Each word of a run but its
first or last q recurs q words on, so the run's words all lie in k-grams that the document
holds twice or more, where k is the least overlap ``max(least, exponent q) - q`` over all q.
Words outside such k-grams are masked; what survives falls into segments, and a run lies in
one.  Main-Lorentz runs over the segments alone: at the middle of each aligned block of
2^t words, every period is tried on the side that holds the longer part of a run, by one
comparison of hashed stretches, and what passes is extended both ways by doubling steps.
All documents of a batch, all middles and all periods of a level go at once through numpy.

Words are compared by 64-bit hashes of their bytes.

Defined results: a null or empty text has no word, no run and collapses to nothing; texts of
any length count whole, with memory in proportion to the longest; of runs at one place each
maximal stretch is one, whatever is repeated; repeated rows are handled each for itself; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.hashing import _STEPS, _powers, chunks, mix64, word_hashes

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Pairs of a middle and a period that are tried at once.
TRIED = 1 << 21


def least_overlap(least: int, exponent: int) -> int:
    """How many words at least a run has besides one period."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def surviving(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of words within k-grams that their document holds twice or more."""
    if len(words) < k + 1:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    grams = doc[: len(words) - k + 1].astype(np.uint64)
    for j in range(k):
        grams = grams + words[j : len(words) - k + 1 + j] * _STEPS[j]
    whole = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :])
    grams = mix64(mix64(grams[whole]) + doc[whole].astype(np.uint64))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[whole[twice]] += 1
    edge[whole[twice] + k] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class Stretches:
    """Equality of stretches of an array by prefix sums of a polynomial hash."""

    def __init__(self, x: np.ndarray):
        up, self.down = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])
        self.n = len(x)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, b after a."""
        out, most = np.zeros_like(a), self.n - b
        for step in (1 << s for s in reversed(range(int(most.max(initial=0)).bit_length()))):
            can = np.flatnonzero(out + step <= most)
            out[can[self.same(a[can] + out[can], b[can] + out[can], np.int64(step))]] += step
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, b after a."""
        out = np.zeros_like(a)
        for step in (1 << s for s in reversed(range(int(a.max(initial=0)).bit_length()))):
            can = np.flatnonzero(out + step <= a)
            out[can[self.same(a[can] - out[can] - step, b[can] - out[can] - step, np.int64(step))]] += step
        return out


def runs_of(x: np.ndarray, longest: int, least: int, exponent: int) -> np.ndarray:
    """(start, end, period) of all runs of an array whose stretches are ``longest`` at most, by start."""
    stretches, found = Stretches(x), []
    size = 2
    while size // 2 < len(x):  # a short run, too, may lie across the middle of a large block
        middles = np.arange(size // 2, len(x), size)
        most = min(size, longest) // exponent
        for q in _blocks(len(middles), most):
            m, q = np.repeat(middles, len(q)), np.tile(q, len(middles))
            shared = (exponent - 2) * q // 2  # of the longer side, besides one period
            for p, held in ((m, m), (m - q, m - q - shared)):
                on = np.flatnonzero((held >= 0) & (held + q + shared <= len(x)) & (p >= 0) & (p + q < len(x)))
                if exponent >= 4:
                    on = on[x[held[on]] == x[held[on] + q[on]]]
                on = on[stretches.same(held[on], held[on] + q[on], shared[on])]
                a, b = p[on], p[on] + q[on]
                start, end = a - stretches.behind(a, b), b + stretches.ahead(a, b)
                good = end - start >= np.maximum(least, exponent * q[on])
                found.append(np.stack([start, end, q[on]], 1)[good])
        size *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    r = np.concatenate(found)
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:, :2] != r[:-1, :2]).any(1)
    r = r[new]  # of one stretch the smallest period
    return r[np.lexsort((r[:, 2], r[:, 0]))]


def _blocks(middles: int, most: int) -> Iterator[np.ndarray]:
    step = max(1, TRIED // max(1, middles))
    for at in range(1, most + 1, step):
        yield np.arange(at, min(at + step, most + 1))


def found_in(texts: list[bytes], least: int = 6, exponent: int = 4) -> list[np.ndarray]:
    """For each text its runs (start, end, period) in words, by start, then period."""
    words, at = word_hashes(texts)
    empty = np.zeros((0, 3), np.int64)
    places = surviving(words, at, least_overlap(least, exponent))
    if not len(places):
        return [empty] * len(texts)
    doc = np.searchsorted(at, places, "right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (doc[1:] != doc[:-1])
    segment = np.cumsum(new) - 1
    longest = int(np.diff(np.append(np.flatnonzero(new), len(places))).max())
    x = mix64(np.arange(len(places) + segment[-1] + 1, dtype=np.uint64) + np.uint64(1 << 40))  # unlike all others, between segments
    x[np.arange(len(places)) + segment] = words[places]
    r = runs_of(x, longest, least, exponent)
    if not len(r):
        return [empty] * len(texts)
    of = np.zeros(len(x), np.int64)
    of[np.arange(len(places)) + segment] = np.arange(len(places))
    first = of[r[:, 0]]
    start = places[first] - at[doc[first]]
    r = np.stack([start, start + r[:, 1] - r[:, 0], r[:, 2]], 1)
    return [r[a:b] for a, b in zip(*(np.searchsorted(doc[first], np.arange(len(texts)), side) for side in ("left", "right")), strict=True)]


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The text's words, one space between, without what a run holds after its first period."""
    words = text.split()
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def collapse(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, runs (start, length, period) by start, then period, and the collapsed text."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = docs.schema[doc_id].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in chunks([(t or "").encode() for t in batch.column("text").to_pylist()]):
                found = found_in(part, least, exponent)
                each = np.concatenate(found)
                runs = pa.StructArray.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1] - each[:, 0]), pa.array(each[:, 2])], fields=list(RUNS.value_type))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                texts = pa.array([collapsed(t, r).decode() for t, r in zip(part, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(part)), pa.ListArray.from_arrays(pa.array(offsets), runs), texts], [doc_id, "runs", "collapsed"])
                done += len(part)

    d = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(made, f"`{doc_id}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
