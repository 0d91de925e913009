"""LM scoring: a bigram model of all words, frequent pairs from a log-frequency Bloom filter.

A word's probability given the one before is (c(h, w) + mass * P(w)) / (c(h) + mass),
with P(w) = (c(w) + add) / total.  Words count exactly.  Pairs of two of the ``classes``
most frequent words, at most classes squared, go to the workers in a filter: a count is
quantised to a step q of a geometric scale, and the pair is put into the filter q times,
with 1 to q; to read a count, a worker asks for 1, 2, ... until a step is missing.  All
other pairs are counted exactly: each of their occurrences goes, with its document's row,
to where its rarer word is counted, so that no key has more than its share of a word
outside the classes.  Exact counts of the ``head`` most frequent words go to the workers
as well; those of all other words follow from the same rows.

Words are known by 64-bit hashes.  Defined results: a null or empty text has the end
token only; a null id counts as the empty text for the split; repeated rows are scored
each for itself but count each in training; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import id_crc32, stored
from quarrystone.llm.hashing import chunks, mix64, word_hashes

#: The end token's hash; no word has it but by chance.
END = np.uint64(0x5EED0FE4D0C5)
#: Distinct n-grams that a task sums before it hands them on.
MOST_SUMMED = 1_000_000


@dataclass(frozen=True)
class Settings:
    classes: int = 2048
    head: int = 200_000
    bits_per_entry: int = 12
    probes: int = 6
    step: float = 1.3
    mass: float = 300.0
    add: float = 0.1


class CountFilter:
    """Quantised counts of integer keys in a Bloom filter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = 12, probes: int = 6, step: float = 1.3):
        self.probes, self.step = probes, step
        levels = self._level(counts)
        self.most = int(levels.max(initial=0))
        self.bits = max(64, int(levels.sum()) * bits_per_entry)
        flags = np.zeros((self.bits + 7) // 8, np.uint8)
        for q in range(1, self.most + 1):
            part = keys[levels >= q]
            for at in range(0, len(part), 1 << 18):
                for place in self._places(part[at : at + (1 << 18)], q):
                    np.bitwise_or.at(flags, place >> np.uint64(3), np.left_shift(1, place & np.uint64(7), dtype=np.uint8, casting="unsafe"))
        self.flags = flags

    def _level(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(self.step) + 1e-9), 0).astype(np.int64)

    def _places(self, keys: np.ndarray, q: int) -> Iterator[np.ndarray]:
        x = mix64(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q))
        y = mix64(x + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        for i in range(self.probes):
            yield (x + np.uint64(i) * y) % np.uint64(self.bits)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of each key's step; 0 for keys that aren't there."""
        level = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for q in range(1, self.most + 1):
            on = np.ones(len(left), bool)
            for place in self._places(keys[left], q):
                on &= (self.flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[on]
            if not len(left):
                break
            level[left] = q
        low = self.step ** (level - 1.0)
        return np.where(level > 0, np.maximum(1.0, (np.ceil(low - 1e-9) + np.maximum(np.ceil(low - 1e-9), np.ceil(low * self.step - 1e-9) - 1)) / 2), 0.0)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end among them, and the texts' offsets."""
    words, at = word_hashes(texts)
    at = np.asarray(at, np.int64)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of bounded size."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [(t or "").encode().lower() for t in batch.column("t").to_pylist()]
            done = 0
            for part in chunks(texts):
                yield batch.slice(done, len(part)), part
                done += len(part)


def _summed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the keys of many parts, summed while there is room."""
    keys, counts, new, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        k = np.concatenate([keys, *(a for a, _ in new)])
        n = np.concatenate([counts, *(b for _, b in new)])
        u, inverse = np.unique(k, return_inverse=True)
        return u, np.bincount(inverse, n, len(u)).astype(np.int64)

    for part in parts:
        new.append(np.unique(part.view(np.int64), return_counts=True))
        waiting += len(new[-1][0])
        if waiting > max(MOST_SUMMED // 2, len(keys) // 2):
            keys, counts = merged()
            new, waiting = [], 0
            if len(keys) > MOST_SUMMED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
    if new:
        keys, counts = merged()
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])


class Words:
    """Numbers of the known words: the end token is 0, others follow by falling count; -1 for all else."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.order[at], -1)


def before(numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What stands before each token; the end token, number 0, stands before the first."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[offsets[:-1]] = 0
    return out


@dataclass
class Model:
    words: Words
    #: Exact counts by number; the first ``classes`` numbers are the classes.
    counts: np.ndarray
    classes: int
    filter: CountFilter
    tokens: int
    distinct: int
    settings: Settings

    @property
    def total(self) -> float:
        return self.tokens + self.settings.add * (self.distinct + 1)

    def pair_logs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the count of a pair of classes adds to the log10 of a pair never seen."""
        s = self.settings
        u, inverse = np.unique(h * self.classes + w, return_inverse=True)
        h, w = u // self.classes, u % self.classes
        prior = s.mass * (self.counts[w] + s.add) / self.total
        return np.log10(np.minimum(1 + self.filter.counts(u) / prior, (self.counts[h] + s.mass) / prior))[inverse]


def fit(docs: DataFrame, counts: DataFrame, settings: Settings) -> Model:
    """``docs`` (t): training texts; ``counts`` (key, n): their stored word counts."""
    s, end = settings, int(END.view(np.int64))
    n, v, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == end, F.col("n"))), F.lit(0))).first()
    top = counts.where(F.col("key") != end).orderBy(F.desc("n"), "key").limit(s.head).toArrow()
    keys, held = top.column("key").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)
    by_count = np.lexsort((keys, -held))
    words = Words(np.append(END, keys[by_count].view(np.uint64)))
    held = np.append(int(ends), held[by_count])
    size = min(s.classes, len(held))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for _, part in _texts(batches):
                tokens, offsets = tokens_of(part)
                w = shared.value.of(tokens)
                w = np.where(w < size, w, -1)
                h = before(w, offsets)
                yield (h * size + w)[(h >= 0) & (w >= 0)]

        return _summed(keys())

    found = docs.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    seen = CountFilter(found.column("key").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64), s.bits_per_entry, s.probes, s.step)
    return Model(words, held, size, seen, int(n), int(v), s)


def count_words(docs: DataFrame) -> DataFrame:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(tokens_of(part)[0] for _, part in _texts(batches))

    return docs.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out_of: int = 10, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (id_crc32(F.col(doc_id)) % held_out_of == 0).alias("held_out"), F.col(text).cast("string").alias("t"))
    learn = d.where("not held_out").select("t")
    counts = stored(count_words(learn), "words")
    model = fit(learn, counts, settings)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    s, size, head, total = settings, model.classes, len(model.counts), model.total
    kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    names = ["by", "other", "learn", "row", "doc"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with what the worker knows, and one for each pair that isn't of two classes."""
        m = shared.value
        bases = np.log10((m.counts + s.add) / total)
        alone = bases + np.log10(s.mass) - np.log10(m.counts + s.mass)
        for batch, part in _texts(batches):
            tokens, offsets = tokens_of(part)
            w = m.words.of(tokens)
            on = w >= 0
            ids = np.where(on, w, tokens.view(np.int64))
            h, h_ids = before(w, offsets), before(ids, offsets)
            right = (w < 0) | (w >= size)
            rest = right | (h < 0) | (h >= size)
            chain = np.where(on, alone[w], 0.0)
            chain[~rest] += m.pair_logs(h[~rest], w[~rest])
            add = lambda x: pa.array(np.add.reduceat(x, offsets[:-1]))
            row = batch.column("row")
            doc = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets)), add((on & (m.counts[w] > 0)).astype(np.int64)), add(np.where(on, bases[w], 0.0)), add(chain)]
            none = pa.array(np.zeros(len(part), bool))
            yield pa.RecordBatch.from_arrays([row, row, none, row, pa.StructArray.from_arrays(doc, fields=list(kind))], names)
            of = np.repeat(np.arange(len(part)), np.diff(offsets))[rest]
            by, other = np.where(right, ids, h_ids)[rest], np.where(right, h_ids, -1 - w)[rest]
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(by), pa.array(other), pa.array(train[of]), pa.array(row.to_numpy()[of]), pa.nulls(len(of), kind)], names)

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rows = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(scored, f"by long, other long, learn boolean, row long, doc struct<{fields.replace(' ', ':').replace(',:', ',')}>").repartition("by")
    # by is the word itself, or the one before it if the word is of a class, which other then names as -1 - number
    left = (F.col("other") < 0) & (F.col("other") >= -size)
    rows = rows.withColumn("n_pair", F.sum(F.col("learn").cast("long")).over(Window.partitionBy("by", "other")))
    rows = rows.withColumn("n_by", F.sum((F.col("learn") & ~left).cast("long")).over(Window.partitionBy("by")))
    classes = spark.createDataFrame([(-1 - i, int(c)) for i, c in enumerate(model.counts[:size])], "other long, n_class long")
    rows = rows.join(F.broadcast(classes), "other", "left")
    n, pair = F.coalesce("n_class", "n_by") + F.lit(s.add), F.col("doc").isNull()
    tail = pair & ~left & ((F.col("by") < 0) | (F.col("by") >= head))
    base = F.when(tail, F.log10(n / F.lit(total))).otherwise(0.0)
    own = F.when(tail, F.lit(math.log10(s.mass)) - F.log10(F.col("n_by") + F.lit(s.mass))).otherwise(0.0)
    more = F.log10(1 + F.col("n_pair") * F.lit(total / s.mass) / n)
    of = lambda name, x: F.when(pair, x).otherwise(F.col(f"doc.{name}")).alias(name)
    each = rows.select("row", "doc.doc_id", "doc.held_out", "doc.n_tokens", of("n_known", (tail & (F.col("n_by") > 0)).cast("long")), of("base", base), of("score", base + own + more))
    out = each.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
