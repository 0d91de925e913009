"""Which documents hold which strings: one pass over each text, however many strings."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.shared import stored

#: Characters of strings that go to the workers at once, about; more take more passes.
PASS_CHARS = 2_000_000


def holding(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "qid", item: str = "text") -> DataFrame:
    """(item_id, doc_id) of every string that is part of a document's text, as it is written.
    Null and empty strings are in no document; the documents are read once a pass."""
    strings = items.select(F.col(item_id).alias("i"), F.col(item).cast("string").alias("s")).where("s <> ''").distinct()
    passes = max(1, -(-(strings.agg(F.sum(F.length("s"))).first()[0] or 0) // PASS_CHARS))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).where("t is not null")
    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    sc, out = docs.sparkSession.sparkContext, None
    for k in range(passes):
        of: dict[str, list] = {}
        for i, s in strings.where(F.pmod(F.xxhash64("i", "s"), F.lit(passes)) == k).collect():
            of.setdefault(s, []).append(i)
        shared = sc.broadcast(of)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for s, ids in shared.value.items():
                automaton.add_word(s, ids)
            if not shared.value:
                return
            automaton.make_automaton()
            for batch in batches:
                rows, ids = [], []
                for n, t in enumerate(batch.column("t").to_pylist()):
                    held = dict.fromkeys(i for _, each in automaton.iter(t) for i in each)
                    rows += [n] * len(held)
                    ids += held
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id").take(pa.array(rows))], [item_id, "doc_id"])

        more = stored(d.mapInArrow(found, f"{item_id} {kinds[1]}, doc_id {kinds[0]}"), "holding")
        out = more if out is None else out.unionByName(more)
    return out
