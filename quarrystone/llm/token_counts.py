"""Token counts by section: offset-mapped attribution.

A document is encoded once and whole.  The byte lengths of its tokens give each
token's span of characters, and an interval join of the sorted spans with the
sections' bounds (a binary search) says which sections a token touches.  A token
across a bound goes by an explicit rule: ``start``, to the section of its first
character; ``end``, of its last; ``most``, to the one with most of its characters,
the earliest of equals.  So the sections' counts add up to the document's.

Texts of any length are encoded whole (``tokenizer`` says what very long white space gives); an
empty table gives no rows.

Defined results: a null or empty text has no section and no token, and no row where
rows are per section; a null field is empty; repeated rows are counted each for
itself; only the named columns of the input are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.tokenizer import Vocabulary, encode

RULES = ("start", "end", "most")


def char_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, from its length in bytes."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    at = np.cumsum(lead) - 1
    ends = np.cumsum(lengths)
    return at[ends - lengths], at[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Each token's section; ``bounds``: the sections' starts and the end of the last."""
    a = np.searchsorted(bounds, first, "right") - 1
    b = np.searchsorted(bounds, last, "right") - 1
    if rule == "start":
        return a
    if rule == "end":
        return b
    if rule != "most":
        raise ValueError(f"the rule is one of {RULES}")
    best, most = a.copy(), np.minimum(bounds[a + 1], last + 1) - first
    for k in np.flatnonzero(b > a):
        for s in range(a[k] + 1, b[k] + 1):
            held = min(bounds[s + 1], last[k] + 1) - bounds[s]
            if held > most[k]:
                best[k], most[k] = s, held
    return best


def line_bounds(text: str) -> np.ndarray:
    """Sections that end with each line end; it belongs to the line that it ends."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.concatenate([[0], at, [] if len(at) and at[-1] == len(text) else [len(text)]]).astype(np.int64)


def count_sections(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text", bounds: Callable[[str], np.ndarray] = line_bounds, rule: str = "start") -> DataFrame:
    """doc_id, section, first_char, n_chars, n_tokens, n_crossing of every section, where
    n_crossing counts the section's tokens that reach into another."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = vocabulary.load()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows, parts = [], []
                for k, t in enumerate(batch.column("t").to_pylist()):
                    if not t:
                        continue
                    ids = np.array(encode(encoder, t), np.int64)
                    first, last = char_spans(t.encode(), lengths[ids])
                    b = bounds(t)
                    n = len(b) - 1
                    of = attribute(first, last, b, rule)
                    crossing = np.searchsorted(b, last, "right") > np.searchsorted(b, first, "right")
                    rows.append(np.full(n, k))
                    parts.append(np.stack([np.arange(n), b[:-1], np.diff(b), np.bincount(of, minlength=n), np.bincount(of[crossing], minlength=n)]))
                if rows:
                    p = np.concatenate(parts, 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(p[0].astype(np.int32)), *map(pa.array, p[1:])], names)

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return d.mapInArrow(counted, f"doc_id {kind}, section int, first_char long, n_chars long, n_tokens long, n_crossing long")


def count_fields(rows: DataFrame, fields: list[str], vocabulary: Vocabulary, *, row_id: str = "doc_id", separator: str = "\n", rule: str = "start") -> DataFrame:
    """row_id, field, n_tokens: the fields are joined, encoded as one text and counted each;
    a separator belongs to the field before it."""
    joined = F.concat_ws(separator, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    ends = F.concat_ws(",", *[F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))).cast("string") for f in fields])
    kind = rows.schema[row_id].dataType.simpleString()
    gap = len(separator)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = vocabulary.load()
        for batch in batches:
            out = []
            for i, t, sizes in zip(*(batch.column(n).to_pylist() for n in ("id", "t", "sizes")), strict=True):
                size = np.array(list(map(int, sizes.split(","))), np.int64)
                size[:-1] += gap
                b = np.concatenate([[0], np.cumsum(size)])
                n = np.zeros(len(fields), np.int64)
                if t:
                    first, last = char_spans(t.encode(), lengths[np.array(encode(encoder, t), np.int64)])
                    n += np.bincount(attribute(first, last, b, rule), minlength=len(fields))
                out += [(i, f, int(c)) for f, c in zip(fields, n, strict=True)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("id").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], [row_id, "field", "n_tokens"])

    return rows.select(F.col(row_id).alias("id"), joined.alias("t"), ends.alias("sizes")).mapInArrow(counted, f"`{row_id}` {kind}, field string, n_tokens long")
