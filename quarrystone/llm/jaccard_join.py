"""N-gram Jaccard join: near duplicates by the exact similarity of shingle sets.

Two sets of similarity t share a member among the first n - ceil(t n) + 1 of each, in
any order common to all; shingles that a sample shows to be frequent come last, the
rest go by hash.  Those members are the tiles' keys.  Texts with equal sets count as
one.  Three rounds find the links, each among sets that are not yet connected:

1. by each set's first keys alone, which similar sets share with a chance of t each,
   every set against its tiles' pivots, those with most company over their tiles;
2. by all keys, every set against the one best pivot of its tiles;
3. by all keys and size bands, the sets of a tile outside its main component against
   all others of the tile that sizes, places and signatures don't rule out.

So a large group of copies takes about as many pairs as members.  A signature is a
bitmap of hashed shingles in which every shingle flips its bit.  Bits in which two
signatures differ are shingles that one set lacks, so their count bounds the overlap
from above; flipping never fills a bitmap up, and its width follows the size band, so
the bound holds for long texts as for short ones (from MOST_BITS shingles on it
weakens).  The rest are decided by intersecting the sorted arrays of shingle hashes
of the whole texts.

Links are never left out: pairs that are skipped are in one component already.

Defined results: a null text or one without words is linked with nothing; a text of
fewer words than a shingle is one shingle; rows with one doc_id and other texts are
judged each for itself, repeated rows are copies of each other; a row without an id is
linked with nothing; texts of any length are compared whole; sets of just the wanted
similarity are linked; an empty table gives no rows; only the named columns of the
input are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import dropped, small_batches, stored
from quarrystone.llm.components import components
from quarrystone.llm.hashing import mix64, shingle_sets

#: Words of the short signature; the long one has a bit for each shingle at least, a power of two.
WORDS = 8
LEAST_BITS, MOST_BITS = 64 * WORDS, 1 << 15
#: Keys of the first round.
FIRST_KEYS = 2
#: Keys or ids up to this many (8 bytes each) are broadcast by hint; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: One document in SAMPLE_STEP tells what shingles are frequent, at least SAMPLE_DOCS of them.
#: This decides which members are keys, and so how many pairs are tried, never the result.
SAMPLE_STEP, SAMPLE_DOCS = 16, 4000
FREQUENT_IN = 3
MOST_FREQUENT = 500_000
#: Rows of texts that a worker holds at once.
SLICE = 64


def _texts(column) -> list[bytes]:
    return [(t or "").encode().lower() for t in column.to_pylist()]


def digest_of(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def band_of(n: int, percent: int) -> int:
    """Sets of the wanted similarity are in one size band or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9)) if percent < 100 else n


def words_of_band(band: int, percent: int) -> int:
    """64-bit words of the signatures that are compared in a tile of this band."""
    most = (100 / percent) ** (band + 1) if percent < 100 else band
    return int(np.clip(1 << int(np.ceil(np.log2(max(most, 1)))), LEAST_BITS, MOST_BITS)) // 64


def signature_of(s: np.ndarray, words: int) -> np.ndarray:
    bits = np.bincount(((s >> np.uint64(7)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def shortened(signature: np.ndarray, words: int) -> np.ndarray:
    """The signature of the same set with fewer bits."""
    return np.bitwise_xor.reduce(signature.reshape(-1, words), axis=0)


def most_common(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """As many shingles as two sets of n and m can share at most, by their signatures."""
    words = min(len(x), len(y))
    x, y = x.view(np.uint64), y.view(np.uint64)  # of a signed number only the size's bits would count
    apart = int(np.bitwise_count(shortened(x, words) ^ shortened(y, words)).sum())
    return min(n, m, (n + m - apart) // 2)


def keys_of(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The first members of the set: frequent ones last, else by hash."""
    n = len(s) - (percent * len(s) + 99) // 100 + 1
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~often], s[often]])
    return s[:n].view(np.int64)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles in FREQUENT_IN or more of the sampled documents, at most MOST_FREQUENT."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(min(SAMPLE_STEP, max(1, n // SAMPLE_DOCS)))) == 0)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for s in shingle_sets(_texts(whole.slice(at, SLICE).column("text")), k):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    found = part.select("text").mapInArrow(members, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT_IN)
    with small_batches(docs.sparkSession):
        rows = found.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).select("s").toArrow().column("s").to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def set_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, band, digest, signature, keys of every document of docs
    (doc_id, mark, text); band and digest are null where the set is empty."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))
    names = ["doc_id", "mark", "n_shingles", "band", "digest", "signature", "keys"]

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sets = shingle_sets(_texts(batch.column("text")), k)
                size = np.array([len(s) for s in sets], np.int64)
                bands = [band_of(len(s), percent) if len(s) else None for s in sets]
                keys = [keys_of(s, percent, frequent.value) if len(s) else s.view(np.int64) for s in sets]
                digests = pa.array([digest_of(s) if len(s) else None for s in sets], pa.int64())
                # Wide enough for the tile of the next band; folded for its own.
                signatures = [signature_of(s, words_of_band(b + 1, percent)) if len(s) else s.view(np.int64) for s, b in zip(sets, bands, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(size), pa.array(bands, pa.int32()), digests, _lists(signatures), _lists(keys)], names)

    return docs.mapInArrow(table, "doc_id long, mark long, n_shingles long, band int, digest long, signature array<long>, keys array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def _folded(signature: Column, words: Column, times: int) -> Column:
    """The signature with its halves laid over each other until it has so many words."""
    for _ in range(times):
        half = (F.size(signature) / 2).cast("int")
        signature = F.when(half >= words, F.zip_with(F.slice(signature, 1, half), F.slice(signature, half + 1, half), _xor)).otherwise(signature)
    return signature


def may_link(percent: int) -> Column:
    """False only if the sizes of sets a and b, the places of their common key or the bits
    in which their signatures differ rule the similarity out."""
    na, nb = F.col("a_n"), F.col("b_n")
    sizes = (100 * nb >= percent * na) & ((100 + percent) * F.least(na - F.col("a_pos"), nb - F.col("b_pos")) >= percent * (na + nb))
    #: Sets that differ in d members share (na + nb - d) / 2 of them.
    close = lambda d: (100 + percent) * d <= (100 - percent) * (na + nb)
    short = sum((F.bit_count(_xor(F.col(f"a_b{j}"), F.col(f"b_b{j}"))) for j in range(WORDS)), F.lit(0))
    each = F.zip_with("a_signature", "b_signature", lambda x, y: F.bit_count(_xor(x, y)))
    long = F.aggregate(each, F.lit(0), lambda x, y: x + y)
    return sizes & close(short) & (F.col("a_signature").isNull() | close(long))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def classes(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, mark, n_shingles, class, component_id, n_copies of every row of docs
    (doc_id, mark, text): class names a component, component_id its smallest doc_id."""
    sets = stored(set_table(docs, k, percent), "sets", texts=True)
    full = sets.where("digest is not null and doc_id is not null")
    one = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "band", "signature"))
    reps = full.groupBy("digest").agg(one.alias("of"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("of.doc_id").alias("rep"), "of.n", "of.band", "of.signature", "copies")
    reps = stored(reps, "reps")
    work = _Work(docs, sets, reps, k, percent)
    first = work.members(first_only=True)
    work.star(first, best_only=False)
    dropped(first)
    members = work.members()
    work.star(members, best_only=True)
    work.rest(members)
    dropped(members)
    placed = work.placed()
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = stored(placed.join(least, "comp").join(reps.select("digest", "copies"), "digest").select("digest", F.col("comp").alias("class"), "component_id", "copies"), "classes")
    dropped(placed, reps)
    out = full.select("doc_id", "mark", "n_shingles", "digest").join(of, "digest").select("doc_id", "mark", "n_shingles", "class", "component_id", F.col("copies").alias("n_copies"))
    alone = sets.where("digest is null or doc_id is null").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def join(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and n_copies with its very set."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), F.col(text).cast("string").alias("text"))
    return classes(slim, k=k, percent=percent).drop("mark", "class")


class _Work:
    """The links found so far, and the rounds that find more; sets go by their digests."""

    def __init__(self, docs: DataFrame, sets: DataFrame, reps: DataFrame, k: int, percent: int):
        self.docs, self.reps, self.k, self.percent = docs.select("doc_id", "text"), reps, k, percent
        self.sets = sets.where("digest is not null and doc_id is not null")
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.components = docs.sparkSession.createDataFrame([], "u long, v long")

    def placed(self) -> DataFrame:
        """Stored (digest, rep, comp, n, band) of every set."""
        d = self.reps.select("digest", "rep", "n", "band").join(self.components, F.col("digest") == F.col("u"), "left")
        return stored(d.select("digest", "rep", F.coalesce("v", "digest").alias("comp"), "n", "band"), "placed")

    def members(self, first_only: bool = False) -> DataFrame:
        """Stored (key, digest, pos, n, band, comp) of tiles that hold sets of different components.

        Only keys and digests are shuffled in bulk, alike at every size; sizes and
        components come to the few that are left."""
        placed = self.placed()
        if first_only:
            d = self.sets.select(F.posexplode(F.slice("keys", 1, FIRST_KEYS)).alias("pos", "key"), "digest", F.col("digest").alias("comp"))
        else:
            d = self.sets.select("doc_id", "digest", "keys").join(placed.select("digest", "rep", "comp"), "digest").where("doc_id = rep")
            keyed = stored(d.select("digest", "comp", "keys"), "keyed")
            d = keyed.select(F.posexplode("keys").alias("pos", "key"), "digest", "comp")
        mixed = d.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("m")).where("l <> m").select("key")
        few = stored(d.select("key", "digest", "pos").join(mixed, "key").distinct(), "tiles")
        out = stored(few.join(placed.select("digest", "n", "band", "comp"), "digest"), "members")
        dropped(placed, few, *([] if first_only else [keyed]))
        return out

    def star(self, members: DataFrame, best_only: bool) -> None:
        """Holds every set against its tiles' pivots, or the best of them."""
        company = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        support = members.join(company, "key").groupBy("digest").agg(F.sum("c").alias("support"))
        known = members.join(support, "digest")
        pivots = known.groupBy("key").agg(F.max(F.struct("support", "digest", "n", "comp")).alias("p"))
        sizes = 100 * F.least("n", "p.n") >= self.percent * F.greatest("n", "p.n")
        pairs = members.join(pivots, "key").where(sizes & (F.col("comp") != F.col("p.comp"))).select(F.col("digest").alias("a"), F.col("p.digest").alias("b"), "p.support")
        pairs = pairs.groupBy("a").agg(F.max(F.struct("support", "b")).alias("x")).select("a", F.col("x.b").alias("b")) if best_only else pairs.select("a", "b").distinct()
        self._try(pairs)

    def rest(self, members: DataFrame) -> None:
        """Holds sets of a tile against each other that are still in different components.

        A tile is a key and a band, that of the larger set of a pair; the smaller one is of
        this band or the one before.  Of the sets of a tile's main component, the one with
        most of its sets, none is held against another of them, nor looked at together."""
        placed = self.placed()
        d = members.drop("comp").join(placed.select("digest", "comp"), "digest")
        small = (100 + self.percent) * (F.col("n") - F.col("pos")) >= 2 * self.percent * F.col("n")
        roles = F.when(small, F.expr("array(struct(true large, band tile), struct(false large, band tile), struct(false large, band + 1 tile))")).otherwise(F.expr("array(struct(true large, band tile))"))
        roles = stored(d.withColumn("of", F.explode(roles)).select("key", "digest", "pos", "n", "comp", "of.large", "of.tile"), "roles")
        each = roles.groupBy("key", "tile", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("large").alias("large"), F.min("large").alias("small"))
        tiles = each.groupBy("key", "tile").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.max("large").alias("large"), F.min("small").alias("small"))
        tiles = tiles.where("comps > 1 and large and not small").select("key", "tile", F.col("top.comp").alias("main"))
        d = stored(roles.join(tiles, ["key", "tile"]).withColumn("odd", F.col("comp") != F.col("main")).drop("main"), "rest")
        dropped(roles, placed)
        if d.take(1):
            both = self._signed(d)
            a, b = _renamed(both.where("large"), "a_").drop("a_large"), _renamed(both.where("not large"), "b_").drop("b_large")
            ordered = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_digest") < F.col("b_digest")))
            on = (F.col("a_key") == F.col("b_key")) & (F.col("a_tile") == F.col("b_tile")) & (F.col("a_comp") != F.col("b_comp")) & ordered & may_link(self.percent)
            pick = [F.col("a_digest").alias("a"), F.col("b_digest").alias("b")]
            pairs = a.where("a_odd").join(b, on).select(*pick).unionByName(a.where("not a_odd").join(b.where("b_odd"), on).select(*pick)).distinct()
            for x, y in (("a", "b"), ("b", "a")):
                pairs = pairs.join(self.tried.select(F.col(x).alias("a"), F.col(y).alias("b")), ["a", "b"], "left_anti")
            self._try(pairs)
            dropped(both)
        dropped(d)

    def _signed(self, d: DataFrame) -> DataFrame:
        """Stored rows of tiles with the short signature and, of large tiles, the whole one."""
        bands = [r[0] for r in d.select("tile").distinct().collect()]
        words = F.element_at(F.create_map(*[F.lit(x) for t in sorted(bands) for x in (t, words_of_band(t, self.percent))]), F.col("tile"))
        needed = d.select("digest", "tile").distinct().join(self.reps.select("digest", "signature"), "digest").withColumn("words", words)
        times = int(np.ceil(np.log2(100 / self.percent)))  # as often as a band can double the width
        whole = needed.select("digest", "tile", _folded(F.col("signature"), F.col("words"), times).alias("signature"))
        folds = F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda j: F.aggregate(F.filter("signature", lambda x, i: (i % WORDS) == j - 1), F.lit(0).cast("long"), _xor))
        s = whole.withColumn("short", folds).select("digest", "tile", *[F.col("short")[j].alias(f"b{j}") for j in range(WORDS)], F.when(F.size("signature") > WORDS, F.col("signature")).alias("signature"))
        return stored(d.join(s, ["digest", "tile"]), "signed")

    def _try(self, pairs: DataFrame) -> None:
        """Bounds, then verifies (a, b); adds the links and connects anew."""
        pairs = stored(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if not pairs.take(1):
            return
        bounded = self._bounded(pairs)
        found = self._verified(bounded)
        dropped(bounded)
        if not found.take(1):
            return
        self.links = found if self.links is None else self.links.unionByName(found)
        was, self.components = self.components, components(self.links)
        dropped(was)

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Stored (a, a_rep, b, b_rep) of pairs that the long signatures don't rule out."""
        r, percent = self.reps.select("digest", "rep", "n", "signature"), self.percent
        d = pairs.join(_renamed(r, "a_"), F.col("a") == F.col("a_digest")).drop("a_digest").join(_renamed(r, "b_"), F.col("b") == F.col("b_digest")).drop("b_digest")

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist()
                x, y = batch.column("a_signature"), batch.column("b_signature")
                most = [most_common(x[i].values.to_numpy(), n[i], y[i].values.to_numpy(), m[i]) for i in range(len(n))]
                on = [i for i, c in enumerate(most) if 100 * c >= percent * (n[i] + m[i] - c)]
                yield batch.select(["a", "a_rep", "b", "b_rep"]).take(pa.array(on, pa.int64()))

        d = d.select("a", "a_rep", "b", "b_rep", "a_n", "b_n", "a_signature", "b_signature")
        return stored(d.mapInArrow(possible, "a long, a_rep long, b long, b_rep long"), "bounded", texts=True)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) of digests among (a, a_rep, b, b_rep), by whole texts."""
        k, percent = self.k, self.percent
        needed = stored(pairs.select(F.col("a_rep").alias("id")).unionByName(pairs.select(F.col("b_rep").alias("id"))).distinct(), "needed")
        texts = stored(self.docs.join(_hinted(needed), F.col("doc_id") == F.col("id"), "left_semi"), "texts")
        if texts.count() > needed.count():  # rows repeat: each text of an id once
            again, texts = texts, stored(texts.distinct(), "texts")
            dropped(again)
        both = pairs.join(_renamed(texts, "x_"), F.col("a_rep") == F.col("x_doc_id")).drop("x_doc_id")
        both = both.join(_renamed(texts, "y_"), F.col("b_rep") == F.col("y_doc_id")).drop("y_doc_id")

        def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple = (None, None)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                    on = []
                    for i, x in enumerate(shingle_sets(_texts(batch.column("x_text")), k)):
                        y = held[1] if held[0] == b[i] else shingle_sets(_texts(batch.column("y_text").slice(i, 1)), k)[0]
                        if digest_of(x) != a[i] or digest_of(y) != b[i]:
                            continue
                        held = (b[i], y)
                        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            on.append(i)
                    yield batch.select(["a", "b"]).take(pa.array(on, pa.int64()))

        out = stored(both.select("a", "b", "x_text", "y_text").mapInArrow(decided, "a long, b long"), "links", texts=True)
        dropped(texts, needed)
        return out
