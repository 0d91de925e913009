"""BM25: statistics, scores and top-k of many questions at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import lexical_tokens, lexical_words
from quarrystone.sources.shared import few, is_there, renamed, shared_dir, version_of

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents whose tokens are counted at once.
COUNTED = 1024
#: Terms of questions that are broadcast at once, and rows (score, doc_id) that a worker keeps for all
#: questions of a pass; more take more passes.
MOST_TERMS, MOST_KEPT = 2_000_000, 4_000_000
#: Numbers that a worker sums at once.
SUMMED = 4_000_000


@dataclass(frozen=True)
class Index:
    """postings (doc_id, term, tf), docs (doc_id, len), terms (term, idf), stats (n, avgdl), and words
    (doc_id, len, terms, tfs), the postings by document: frames.  Where a doc_id came twice there are
    no words but ``merged`` ones; without either, scores are joined."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    merged: DataFrame | None = None

    def consistent(self) -> bool:
        """As many documents as the statistics say; else the lexical arm must stay off."""
        return self.docs.count() == self.stats.first()["n"]


def counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, len, terms, tfs) of texts: a document's terms are counted where it is read.  Words are
    split by Arrow at the white space that ``lexical_tokens`` splits at (tab to carriage return, space)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                split = pc.ascii_split_whitespace(batch.column("words"))
                of, tokens = pc.list_parent_indices(split), split.flatten()
                on = pc.not_equal(tokens, "")  # white space at the ends
                of, tokens = of.filter(on).to_numpy(), tokens.filter(on)
                length = np.bincount(of, minlength=len(split))
                coded = tokens.dictionary_encode()
                n = max(1, len(coded.dictionary))
                key, tf = np.unique(of * n + coded.indices.to_numpy(), return_counts=True)
                starts = pa.array(np.searchsorted(key, np.arange(len(length) + 1) * n).astype(np.int32))
                terms = pa.ListArray.from_arrays(starts, coded.dictionary.take(pa.array(key % n)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), terms, pa.ListArray.from_arrays(starts, pa.array(tf))], ["doc_id", "len", "terms", "tfs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), lexical_words(F.col(text)).alias("words")).mapInArrow(count, f"doc_id {kind}, len long, terms array<string>, tfs array<long>")


def postings_of(words: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, term, tf), a row for each term of a document."""
    return words.select("doc_id", *more, F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x")).select("doc_id", *more, "x.term", "x.tf")


def by_document(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """The words of postings; documents without any aren't there."""
    d = postings.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    return d.join(docs, "doc_id").select("doc_id", "len", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))


def merged(words: DataFrame) -> DataFrame:
    """(doc_id, lens, times, terms, tfs), a row for each doc_id.  Rows that share one (or have none) are one
    document: its terms are added up, and weighed with each length as often as rows have it.  Only
    such rows are added up."""
    twice = few(words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "twice")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    once = words.join(twice, same, "left_anti").select("doc_id", F.array("len").alias("lens"), F.array(F.lit(1).cast("long")).alias("times"), "terms", "tfs")
    more = words.join(twice, same, "left_semi")
    tfs = postings_of(more).groupBy(F.col("doc_id").alias("id"), "term").agg(F.sum("tf").alias("tf")).groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    lens = more.groupBy("doc_id", "len").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("len", "n")).alias("y"))
    d = lens.join(tfs, same, "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<term:string,tf:bigint>>")))
    return once.unionByName(d.select("doc_id", F.col("y.len").alias("lens"), F.col("y.n").alias("times"), F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs")))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", root: str | None = None) -> Index:
    """Tokenizes texts once and writes the words by document; only terms and their numbers of
    documents are shuffled, added up before.  Rows that share a doc_id are one document's postings."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"

    def kept(d: DataFrame, name: str) -> DataFrame:
        d.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(d.schema).parquet(f"{root}/{name}")

    words = kept(counted(docs, doc_id, text), "words")
    lengths, one = words.select("doc_id", "len"), words
    if repeated := bool(lengths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)):
        one = kept(merged(words), "merged")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    each = one.select(F.explode("terms").alias("term"))
    terms = kept(weighted_terms(kept(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts"), stats), "terms")
    return Index(postings_of(one), lengths, terms, kept(stats, "stats"), *((None, one) if repeated else (words,)))


def weighted_terms(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df): frequent terms get a share of the mean instead of a negative weight."""
    raw = counts.join(F.broadcast(stats), F.lit(True))
    raw = raw.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def load(spark, path: str) -> Index:
    """Raises if the tables don't belong together."""
    words, terms, stats = (spark.read.parquet(f"{path}/{name}") for name in ("words", "terms", "stats"))
    one = spark.read.parquet(f"{path}/merged") if is_there(spark, f"{path}/merged") else None
    index = Index(postings_of(words if one is None else one), words.select("doc_id", "len"), terms, stats, words if one is None else None, one)
    if not index.consistent():
        raise ValueError("the index has other documents than its statistics")
    return index


def of_snapshot(docs: DataFrame, path: str, **columns) -> Index:
    """The index of the table at a path, built once for each version of it and kept in the
    shared folder; what is half written stands beside and is never read."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/lexical-by-id-{version_of(spark, path)}"
    if not is_there(spark, f"{root}/stats/_SUCCESS"):
        by = f"{root}.{uuid.uuid4().hex}"
        build(docs, root=by, **columns)
        renamed(spark, by, root)  # of two sessions that build at once, the first stays
    return load(spark, root)


def question_terms(questions: DataFrame, qid: str = "qid", text: str = "text", *more: str) -> DataFrame:
    """(qid, term, qtf): a term counts as often as the question has it."""
    keys = [F.col(c) for c in (qid, *more)]
    return questions.select(*keys, F.explode(lexical_tokens(F.col(text))).alias("term")).groupBy(qid, *more, "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(index: Index, terms: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """(keys, doc_id, score).  The questions' terms meet the postings first, so that only
    postings that count are weighed."""
    d = index.postings.join(terms, "term").join(index.terms.select("term", "idf"), "term").join(index.docs, "doc_id").join(F.broadcast(index.stats), F.lit(True))
    return summed(d, keys, digits)


def summed(d: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Scores of postings (keys, doc_id, qtf, idf, tf, len, avgdl)."""
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return d.groupBy(*keys, "doc_id").agg(F.round(F.sum(part), digits).alias("score"))


def ranked(scored: DataFrame, keys: list[str], most: int | Column, *ties: str) -> DataFrame:
    """The best of each question, ranked from 1; ties go by the columns named, then doc_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *ties, "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``first`` on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _pass(index: Index, weights: DataFrame, most: int, digits: int) -> DataFrame:
    """(qid, doc_id, score): the ``most`` best of each question in each task."""
    rows = weights.sort("qid", "v").toArrow().combine_chunks()
    names = pa.array(pc.unique(rows.column("term")).to_pylist(), pa.string())
    of_term = pc.index_in(rows.column("term"), value_set=names).to_numpy().astype(np.int64)
    asked, v = rows.column("qid").to_numpy(), rows.column("v").to_numpy()
    new = np.ones(len(v), bool)
    new[1:] = (asked[1:] != asked[:-1]) | (v[1:] != v[:-1])
    column = np.cumsum(new) - 1  # one for each variant; those of a question stand together
    ids = asked[new]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(of_term, kind="stable")
    first = np.searchsorted(of_term[order], np.arange(len(names) + 1))
    avgdl = index.stats.first()["avgdl"] or 1.0
    words = index.merged if index.words is None else index.words.withColumns({"lens": F.array("len"), "times": F.array(F.lit(1).cast("long"))})
    shared = words.sparkSession.sparkContext.broadcast((names, first, column[order], rows.column("w").to_numpy()[order], ids[starts], starts, len(ids)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, column, weight, ids, starts, wide = shared.value
        if not len(ids):
            return
        size = max(1, min(COUNTED, SUMMED // max(wide, len(column))))
        least, held, new, n = np.full(len(ids), np.finfo(float).tiny), None, [], 0

        def best():
            q, s, k = (np.concatenate(x) for x in zip(*([held] if held else []), *new, strict=True))
            at = np.lexsort((k, -s, q))
            q, s, k = q[at], s[at], k[at]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = place == most - 1
            least[q[full]] = s[full]
            on = place < most
            return q[on], s[on], k[on]

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                terms, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
                of = pc.fill_null(pc.index_in(terms.flatten(), value_set=names), -1).to_numpy()
                on = np.flatnonzero(of >= 0)
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy())[on]
                of, tf = of[on], tf[on]
                lens, times = batch.column("lens"), batch.column("times").flatten().to_numpy()
                over, n_lens = K1 * (1 - B + B * lens.flatten().to_numpy() / avgdl), pc.list_value_length(lens).to_numpy()
                count = n_lens[doc]
                to, i = _ranges((np.cumsum(n_lens) - n_lens)[doc], count), np.repeat(np.arange(len(doc)), count)
                part = np.bincount(i, times[to] * (tf[i] * (K1 + 1) / (tf[i] + over[to])), len(doc))
                count = first[of + 1] - first[of]
                to = _ranges(first[of], count)
                s = np.bincount(np.repeat(doc * wide, count) + column[to], np.repeat(part, count) * weight[to], batch.num_rows * wide).reshape(-1, wide)
                s = np.maximum.reduceat(s, starts, axis=1) if len(starts) < wide else s
                s = np.floor(s * 10**digits + 0.5) / 10**digits
                row, q = np.nonzero(s >= least)
                new.append((q, s[row, q], batch.column("doc_id").to_numpy()[row]))
                n += len(row)
                if n > max(500_000, 2 * most * len(ids)):
                    held, new, n = best(), [], 0
        if new:
            held = best()
        if held:
            for at in range(0, len(held[0]), 100_000):
                q, s, k = (x[at : at + 100_000] for x in held)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(k), pa.array(s)], ["qid", "doc_id", "score"])

    kinds = dict(weights.dtypes) | dict(words.dtypes)
    return words.where("doc_id is not null").select("doc_id", "lens", "times", "terms", "tfs").mapInArrow(blocks, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")


def best(index: Index, terms: DataFrame, most: int, variant: str | None = None, digits: int = 4) -> DataFrame:
    """(qid, doc_id, score, rank) of questions' terms (qid, variant, term, qtf); over variants of a
    question, the best score counts.

    Documents meet all questions where they are read: a task sums the weights of its documents' terms
    and keeps the ``most`` best of each question, so what is shuffled follows tasks and questions,
    and no pair of a question and a document is a row.  Questions' terms are counted before they are
    fetched and go to the workers in as many passes as their bound asks for."""
    if index.words is None and index.merged is None:
        found = scores(index, terms, ["qid", variant] if variant else ["qid"], digits).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
        return ranked(found.where("score > 0"), ["qid"], most)
    terms = terms.where("qid is not null")
    n, asked = terms.agg(F.count(F.lit(1)), F.count_distinct("qid")).first()
    passes = max(1, -(-n // MOST_TERMS), -(-asked * most // MOST_KEPT))
    weights = terms.select("qid", (F.col(variant) if variant else F.lit(0)).alias("v"), "term", "qtf")
    part = None
    for one in range(passes):
        some = weights if passes == 1 else weights.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == one)
        some = index.terms.select("term", "idf").join(F.broadcast(some), "term").select("qid", "v", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        more = _pass(index, some, most, digits)
        part = more if part is None else part.unionByName(more)
    return ranked(part, ["qid"], most)


def top(index: Index, questions: DataFrame, most: int, variant: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank); over variants of a question, the best score counts."""
    return best(index, question_terms(questions, "qid", "text", *([variant] if variant else [])), most, variant)


def top_then_filter(index: Index, questions: DataFrame, docs: DataFrame, keep: Column, k: int) -> DataFrame:
    """The best 5k first, filters then, 3k at last: filters don't reach below the ranking."""
    found = few(top(index, questions, 5 * k).drop("rank"), "five").join(docs, "doc_id").where(keep)
    return ranked(found, ["qid"], 3 * k).select("qid", "doc_id", "score", "rank")


def weighted_fields(docs: DataFrame, questions: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(qid, doc_id, score): each distinct term of a question that a field holds brings the field's weight."""
    by_weight: dict[float, list[str]] = {}
    for f, w in fields.items():
        by_weight.setdefault(w, []).append(f)
    weighed = lambda fs, w: F.transform(F.array_distinct(F.concat(*[lexical_tokens(F.col(f)) for f in fs])), lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    terms = F.concat(*[weighed(fs, w) for w, fs in by_weight.items()])
    held = docs.select("doc_id", F.explode(terms).alias("x")).select("doc_id", "x.term", "x.weight")
    return held.join(question_terms(questions), "term").groupBy("qid", "doc_id").agg(F.round(F.sum("weight"), 4).alias("score"))
