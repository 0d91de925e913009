"""Benchmark decontamination: pigeonhole edit matching.

Texts are lower-cased and their white space runs become one space.  A test item of m
characters may differ from a passage by ``int(rate * m)`` edits.  Cut into one piece
more than that, at least one piece is in the passage unchanged: an Aho-Corasick
automaton over all pieces finds the exact hits, each of which fixes where the item
would lie, and Myers' bit-parallel distance decides on that window.

Defined results: null and empty texts, and items that are empty after normalising,
match nothing; equal items of different ids are matched each, repeated rows of an item
count once, an item without an id is reported with a null one; a document is reported
once per item and row, with its best place, the first of equals; texts of any length
are searched whole, items of any number in passes; empty tables give no rows; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import stored

#: Characters of items per pass, about: bounds the automaton and its broadcast.
PASS_CHARS = 2_000_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    n = min(errors, len(item) - 1) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(pattern: str, text: str, anchored: bool = False, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the place in text that is nearest to the pattern, the first of
    equals; with ``anchored`` the place begins where the text does."""
    masks = _masks(pattern) if masks is None else masks
    m = len(pattern)
    ones, top = (1 << m) - 1, m - 1
    up, down, score = ones, 0, m
    best = (m, 0)
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise = down | (ones & ~(xh | up))
        fall = up & xh
        score += (rise >> top & 1) - (fall >> top & 1)
        rise = (rise << 1 | anchored) & ones
        fall = fall << 1 & ones
        up = fall | (ones & ~(xv | rise))
        down = rise & xv
        if score < best[0]:
            best = (score, k + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t)), _masks(t)) for i, t in items if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e, _) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                at.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) for each item that the normalised text holds."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, set()).add(end + 1 - n - offset)
        out = []
        for k, places in starts.items():
            i, t, e, masks = self.items[k]
            exact = text.find(t) if any(text.startswith(t, p) for p in places if p >= 0) else -1
            if exact >= 0:
                out.append((i, exact, exact + len(t), 0))
                continue
            best, done = (e + 1, 0, 0), -1
            for p in sorted(places):
                if p - e < done:
                    low = max(0, done - len(t) - 2 * e)
                else:
                    low = max(0, p - e)
                high = min(len(text), p + len(t) + e)
                if high <= done:
                    continue
                done = high
                d, end = myers(t, text[low:high], masks=masks)
                if d < best[0]:
                    best = (d, low, low + end)
            if best[0] <= e:
                d, low, end = best
                _, back = myers(t[::-1], text[max(0, end - len(t) - e) : end][::-1], anchored=True)
                out.append((i, end - back, end, d))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, distance; places are in the normalised text.

    The test items go to the workers in as many passes of about ``pass_chars`` characters
    as they take; the driver holds one pass at a time.  Documents are read once a pass and
    never shuffled, and each pass's hits are stored.  ``doc_id`` may be of any type."""
    t = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), t.alias("t")).where("t <> ''").distinct()
    passes = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // pass_chars))
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    sc, out = docs.sparkSession.sparkContext, None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        part = sorted(((i, normalise(x)) for i, x in part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = sc.broadcast((part, rate))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                rows, hits = [], []
                for k, t in enumerate(batch.column("t")):
                    for hit in matcher.find(normalise(t.as_py() or "")):
                        rows.append(k)
                        hits.append(hit)
                if hits:
                    columns = [pa.array(c, pa.int64()) for c in zip(*hits, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *columns], ["doc_id", "item_id", "start", "end", "distance"])

        more = stored(d.mapInArrow(found, f"doc_id {kind}, item_id long, start long, end long, distance long"), "hits", texts=True)
        shared.destroy()
        out = more if out is None else out.unionByName(more)
    return out
