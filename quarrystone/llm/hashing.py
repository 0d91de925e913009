"""Hashes of words, word runs and character n-grams of whole batches in numpy.

All are 64-bit polynomial hashes of bytes under a table of random values, mixed at
the end; they depend on the bytes alone, so every worker and every run agrees.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes hashed at once at most, unless one text is longer: bounds a worker's memory.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _prefix(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:])
    return sums, down


def spans_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = _prefix(buffer)
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's offsets in them (one more than texts)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return spans_hash(data, starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of ``k`` words; of the whole
    sequence if it has fewer words; empty if it has none."""
    out: list[np.ndarray] = []
    for part in chunks(texts):
        words, at = word_hashes(part)
        runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            runs += words[j : len(words) - k + 1 + j] * _STEPS[j]
        runs = mix64(runs)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def chunks(texts: list[bytes]):
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def subwords(words: list[bytes], least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's byte n-grams, its ends marked, and of the word itself;
    with each word's offsets (one more than words)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    ends = np.cumsum([len(w) for w in marked])
    starts = ends - [len(w) for w in marked]
    sums, down = _prefix(data)
    size = ends - starts
    counts = 1 + sum(np.maximum(0, size - n + 1) for n in range(least, most + 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    fill = offsets[:-1].copy()
    out[fill] = mix64((sums[ends] - sums[starts]) * down[starts])
    fill += 1
    for n in range(least, most + 1):
        many = np.maximum(0, size - n + 1)
        total = many.sum()
        before = np.cumsum(many) - many
        within = np.arange(total) - np.repeat(before, many)
        at = np.repeat(starts, many) + within
        out[np.repeat(fill, many) + within] = mix64((sums[at + n] - sums[at]) * down[at] + np.uint64(n))
        fill += many
    return (out % np.uint64(buckets)).astype(np.int32), offsets
