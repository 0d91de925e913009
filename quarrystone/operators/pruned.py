"""BM25 top k from impact-ordered postings, most of which are never weighed.

Documents are cut into segments where their words are read, some ``SEGMENT`` postings each; nothing
is shuffled for that.  Within a segment postings are stored by term and falling impact, ``BLOCK`` of a
term as one row: numbers of documents in the segment, and how often they have the term.  A block knows
its largest impact but for idf, which is a term's own.

A question's threshold is the k-th best whole score of those documents that give most in the
first blocks of its terms.  Blocks of the terms asked for then meet by segment, so that a task holds
all that its documents have of any question, and no pair of a question and a document is a row
before it is among the best.  There a question's weakest terms, whose largest impacts together don't
reach the threshold, bring up no document of their own.  Of the others a block is read only
if its largest impact and the largest of all other terms together reach the threshold; a document
found goes on only if what it has and what isn't added yet could give reach it, and is looked up in the
remaining terms, strongest first, as long as it does.  So rows, ties and rounding are those of ``lexical.top``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators import lexical
from quarrystone.sources.shared import few, is_there, renamed, shared_dir, stored, version_of

BLOCK = 256
#: Postings of a segment, about, and documents that are taken into it at once.
SEGMENT, TAKEN = 500_000, 256
#: Postings of a term, about, by which thresholds are sought.
FIRST = 512
#: Scores are rounded to four digits: what is so little below the threshold may tie with it.
SLACK = 1e-4


@dataclass(frozen=True)
class Blocks:
    """postings (segment, term, block, most, size, docs, tfs) by term and falling impact, a row a block; headers,
    the same without docs and tfs; documents (segment, block, ids, lens, times) in the order of their numbers."""

    postings: DataFrame
    headers: DataFrame
    documents: DataFrame


def _shares(doc: np.ndarray, tf: np.ndarray, lens: pa.ListArray, times: pa.ListArray, avgdl: float) -> np.ndarray:
    """Impacts of postings but for idf; a document of several lengths is weighed with each."""
    over, times = lexical.K1 * (1 - lexical.B + lexical.B * lens.flatten().to_numpy() / avgdl), times.flatten().to_numpy()
    n = pc.list_value_length(lens).to_numpy()
    if len(over) == len(n):
        return times[doc] * (tf * (lexical.K1 + 1) / (tf + over[doc]))
    first, count = (np.cumsum(n) - n)[doc], n[doc]
    to, i = lexical._ranges(first, count), np.repeat(np.arange(len(doc)), count)
    return np.bincount(i, times[to] * (tf[i] * (lexical.K1 + 1) / (tf[i] + over[to])), len(doc))


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def build(index: lexical.Index, root: str, block: int = BLOCK) -> Blocks:
    """Cuts documents into segments and stores their postings in order, in one pass over their words."""
    avgdl = index.stats.first()["avgdl"] or 1.0
    words = words_of(index).where("doc_id is not null and size(terms) > 0")
    kind = dict(words.dtypes)["doc_id"]

    def laid(held: list[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
        ids, lens, times, terms, tfs = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "lens", "times", "terms", "tfs"))
        n = len(ids)
        coded, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy()
        code = coded.indices.to_numpy()
        doc = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(terms).to_numpy())
        share = _shares(doc, tf, lens, times, avgdl)
        order = np.lexsort((-share, code))
        code, doc, tf, share, names = code[order], doc[order], tf[order], share[order], coded.dictionary
        del order, terms, tfs, coded
        new = np.append(True, code[1:] != code[:-1])
        at = np.flatnonzero(new)
        nth = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
        starts = np.append(np.flatnonzero(nth % block == 0), len(code))
        row = starts[:-1]
        cuts = np.append(np.arange(0, n, lexical.COUNTED), n)
        columns, rows = ["segment", "term", "block", "most", "size", "docs", "tfs", "ids", "lens", "times"], len(cuts) - 1
        none = lambda like, m: pa.nulls(m, like)
        parts = lambda x: _lists(x, cuts)
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, segment)), none(pa.string(), rows), pa.array(np.arange(rows)), none(pa.float64(), rows), none(pa.int32(), rows), none(ints, rows), none(ints, rows), parts(ids), parts(lens), parts(times)], columns
        )
        docs, tfs, m = _lists(pa.array(doc), starts), _lists(pa.array(tf.astype(np.int32)), starts), len(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, segment)), names.take(pa.array(code[row])), pa.array(np.arange(m)), pa.array(share[row]), pa.array(np.diff(starts).astype(np.int32)), docs, tfs, none(parts(ids).type, m), none(parts(lens).type, m), none(parts(times).type, m)], columns
        )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held, n = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, TAKEN):
                some = whole.slice(at, TAKEN)
                more = pc.sum(pc.list_value_length(some.column("terms"))).as_py()
                if held and n + more > SEGMENT:
                    yield from laid(held, segment)
                    segment, held, n = segment + 1, [], 0
                held.append(some)
                n += more
            held = [b.take(pa.array(np.arange(b.num_rows))) for b in held]  # so that the whole batch can go
        if held:
            yield from laid(held, segment)

    schema = f"segment long, term string, block long, most double, size int, docs array<int>, tfs array<int>, ids array<{kind}>, lens array<array<long>>, times array<array<long>>"
    words.mapInArrow(segments, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/blocks")
    return load(index.stats.sparkSession, root)


def load(spark, root: str) -> Blocks:
    d = spark.read.parquet(f"{root}/blocks")
    headers = d.where("term is not null").select("segment", "term", "block", "most", "size")
    return Blocks(d.where("term is not null").select(*headers.columns, "docs", "tfs"), headers, d.where("term is null").select("segment", "block", "ids", "lens", "times"))


def of_snapshot(index: lexical.Index, docs: DataFrame, path: str) -> Blocks:
    """The blocks of the table at a path, built once for each version of it."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/impacts-by-segment-{version_of(spark, path)}"
    if not is_there(spark, f"{root}/blocks/_SUCCESS"):
        by = f"{root}.{uuid.uuid4().hex}"
        build(index, by)
        renamed(spark, by, root)  # of two sessions that build at once, the first stays
    return load(spark, root)


def words_of(index: lexical.Index) -> DataFrame:
    """(doc_id, lens, times, terms, tfs), a row for each doc_id."""
    if index.words is None and index.merged is not None:
        return index.merged
    words = lexical.by_document(index.postings, index.docs) if index.words is None else index.words
    return words.select("doc_id", F.array("len").alias("lens"), F.array(F.lit(1).cast("long")).alias("times"), "terms", "tfs")


def scored(index: lexical.Index, terms: DataFrame, pairs: DataFrame, digits: int = 4) -> DataFrame:
    """(qid, doc_id, score): whole scores of few pairs (qid, doc_id) by weighted terms (qid, term, w); only
    their documents' words are spread."""
    d = lexical.postings_of(words_of(index).join(pairs, "doc_id"), "lens", "times", "qid").join(terms, ["qid", "term"])
    over = lambda n: lexical.K1 * (1 - lexical.B + lexical.B * n / F.col("avgdl"))
    share = lambda n, t: t * (F.col("tf") * (lexical.K1 + 1) / (F.col("tf") + over(n)))
    part = F.col("w") * F.aggregate(F.zip_with("lens", "times", share), F.lit(0.0), lambda a, b: a + b)
    return d.join(F.broadcast(index.stats), F.lit(True)).groupBy("qid", "doc_id").agg(F.round(F.sum(part), digits).alias("score"))


def _by_segment(blocks: Blocks, index: lexical.Index, postings: DataFrame, asked: DataFrame, k: int, what: str) -> DataFrame:
    """What each segment's task finds for questions' terms (qid, term, w, threshold) in blocks of
    these terms.  ``first``: (qid, doc_id, score), the k that have most in these blocks; ``best``: the k best with
    whole scores; ``maybe``: (qid, doc_id) of those looked up in more than the blocks read; ``read``:
    these blocks (qid, term, segment, block, size)."""
    rows = asked.sort("qid", "term").toArrow().combine_chunks()
    qid, names = rows.column("qid").combine_chunks(), pa.array(pc.unique(rows.column("term")).to_pylist(), pa.string())
    code = pc.index_in(rows.column("term"), value_set=names).to_numpy().astype(np.int64)
    new = np.flatnonzero(np.append(True, pc.not_equal(qid[1:], qid[:-1]).to_numpy(zero_copy_only=False))) if len(qid) else np.zeros(0, np.int64)
    threshold = pc.fill_null(rows.column("threshold"), 0.0).to_numpy()[new]
    bars = np.where(threshold > 0, threshold - SLACK, -np.inf)
    avgdl = index.stats.first()["avgdl"] or 1.0
    shared = blocks.postings.sparkSession.sparkContext.broadcast((qid.take(pa.array(new)), names, code, rows.column("w").to_numpy(), np.append(new, len(qid)), bars))
    kinds = {"qid": dict(asked.dtypes)["qid"], "doc_id": dict(blocks.documents.dtypes)["ids"][len("array<") : -1], "score": "double", "term": "string", "segment": "long", "block": "long", "size": "int"}
    columns = {"first": ["qid", "doc_id", "score"], "best": ["qid", "doc_id", "score"], "maybe": ["qid", "doc_id"], "read": ["qid", "term", "segment", "block", "size"]}[what]

    def found(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        qids, names, code, weight, starts, bars = shared.value
        documents = table.filter(pc.is_null(table.column("term"))).sort_by("block").combine_chunks()
        ids, lens, times = (documents.column(c).combine_chunks().flatten() for c in ("ids", "lens", "times"))
        table = table.select(["term", "block", "most", "size", "docs", "tfs"]).filter(pc.is_valid(table.column("term")))
        of = pc.index_in(table.column("term"), value_set=names).to_numpy()
        order = np.lexsort((table.column("block").to_numpy(), of))
        of, table = of[order], table.take(pa.array(order)).combine_chunks()
        most, size, block = (table.column(c).to_numpy() for c in ("most", "size", "block"))
        doc, tf = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "tfs"))
        share, at = _shares(doc, tf, lens, times, avgdl), np.append(0, np.cumsum(size))
        head = np.searchsorted(of, np.arange(len(names) + 1))
        by_id, out = ids.to_numpy(zero_copy_only=False), []

        def best(q: int, some: np.ndarray, score: np.ndarray) -> None:
            some = (pick := np.lexsort((by_id[some], -score))[:k], some[pick])[1]
            out.append((np.full(len(some), q), some, score[pick]))

        for q in range(len(qids)):
            t, w = code[starts[q] : starts[q + 1]], weight[starts[q] : starts[q + 1]]
            here = head[t + 1] > head[t]
            t, w = t[here], w[here]
            if not len(t):
                continue
            upper = np.maximum(w * most[head[t]], 0.0)  # a document may lack a term
            by = np.argsort(-upper, kind="stable")
            t, w, upper = t[by], w[by], upper[by]
            together, bar = np.cumsum(upper[::-1])[::-1], bars[q] if what != "first" else -np.inf
            if together[0] < bar:
                continue
            part, rest = np.zeros(len(ids)), []
            for j in range(len(t)):
                a, z = head[t[j]], head[t[j] + 1]
                n = a
                if w[j] > 0 and together[j] >= bar:
                    n += np.searchsorted(-(w[j] * most[a:z]), together[0] - upper[j] - bar, side="right")
                    if what == "read":
                        out.append((np.full(n - a, q), np.full(n - a, t[j]), np.arange(a, n)))
                    part[doc[at[a] : at[n]]] += w[j] * share[at[a] : at[n]]
                if n < z:
                    rest.append((max(w[j] * most[n], 0.0), w[j], at[n], at[z]))
            if what == "read":
                continue
            left = sum(x[0] for x in rest)
            some = np.flatnonzero(part > 0)
            some = some[part[some] + left >= bar]
            if what == "maybe":
                out.append((np.full(len(some), q), some))
                continue
            if what == "first":
                best(q, some, part[some])
                continue
            for most_left, w_left, a, z in sorted(rest, key=lambda x: -x[0]):
                if not len(some):
                    break
                mark = np.zeros(len(ids), bool)
                mark[some] = True
                on = np.flatnonzero(mark[doc[a:z]]) + a
                part[doc[on]] += w_left * share[on]
                left -= most_left
                some = some[part[some] + left >= bar]
            score = np.floor(part[some] * 10**4 + 0.5) / 10**4
            best(q, some[score > 0], score[score > 0])

        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if what == "read" else float))]
        first, *more = (np.concatenate(x) for x in zip(*out, strict=True))
        if what == "read":
            term, i = more
            return pa.Table.from_arrays([qids.take(pa.array(first)), names.take(pa.array(term)), pa.array(np.full(len(i), key[0].as_py(), np.int64)), pa.array(block[i]), pa.array(size[i])], names=columns)
        return pa.Table.from_arrays([qids.take(pa.array(first)), ids.take(pa.array(more[0])), *map(pa.array, more[1:])][: len(columns)], names=columns)

    p, e = postings, blocks.documents
    missing = lambda d, names: [F.lit(None).cast(t).alias(c) for c, t in d.dtypes if c in names]
    p = p.select("segment", "term", "block", "most", "size", "docs", "tfs", *missing(e, ("ids", "lens", "times")))
    e = e.select("segment", *missing(postings, ("term",)), "block", *missing(postings, ("most", "size", "docs", "tfs")), "ids", "lens", "times")
    return p.unionByName(e).groupBy("segment").applyInArrow(found, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _place(by: str) -> Column:
    return F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "doc_id"))


def thresholds(blocks: Blocks, index: lexical.Index, terms: DataFrame, k: int) -> DataFrame:
    """(qid, threshold) where the first blocks of the terms bring up k documents."""
    names = few(terms.select("term").distinct(), "names")
    order = Window.partitionBy("term").orderBy(F.desc("most"), "segment", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = blocks.headers.join(names, "term", "left_semi").withColumn("before", F.sum("size").over(order) - F.col("size"))
    place = F.struct((-F.col("most")).alias("most"), "segment", "block")
    last = few(before.where(F.col("before") < FIRST).groupBy("term").agg(F.max(place).alias("last")), "last")
    first = blocks.postings.join(last, "term").where(place <= F.col("last")).drop("last")
    part = _by_segment(blocks, index, first, terms.withColumn("threshold", F.lit(0.0)), 4 * k, "first")
    likely = few(part.withColumn("place", _place("score")).where(F.col("place") <= 4 * k).select("qid", "doc_id"), "likely")
    return scored(index, terms, likely, 9).withColumn("place", _place("score")).where(F.col("place") == k).select("qid", F.col("score").alias("threshold"))


def top(blocks: Blocks, index: lexical.Index, questions: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank), the rows of ``lexical.top``."""
    return weighed(blocks, index, questions, k)[0]


def weighed(blocks: Blocks, index: lexical.Index, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows; the blocks read (qid, term, segment, block, size); the documents looked up in more than these
    (qid, doc_id).  Questions' terms go to the workers in as many passes as their bound asks for."""
    asked = few(lexical.question_terms(questions).where("qid is not null"), "asked")
    terms = stored(index.terms.select("term", "idf").join(asked, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w")), "weights")
    n, ids = terms.agg(F.count(F.lit(1)), F.count_distinct("qid")).first()
    passes, out = max(1, -(-n // lexical.MOST_TERMS), -(-ids * 4 * k // lexical.MOST_KEPT)), None
    for one in range(passes):
        some = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == one)
        some = stored(some.join(thresholds(blocks, index, some, k), "qid", "left"), "asked")
        postings = blocks.postings.join(few(some.select("term").distinct(), "names"), "term", "left_semi")
        more = [_by_segment(blocks, index, postings, some, k, what) for what in ("best", "read", "maybe")]
        out = more if out is None else [a.unionByName(b) for a, b in zip(out, more, strict=True)]
    return lexical.ranked(out[0], ["qid"], k), out[1], out[2]
