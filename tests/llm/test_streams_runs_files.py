"""Click windows, periodic runs and token files against plain-Python twins."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import uuid
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrystone.llm import click_dedup, periodic_runs, queries, token_files

SF = "/root/testdata/sf0.001"
EPOCH = datetime.datetime(1970, 1, 1)


# Clicks


def folded(batches: list[list[tuple]], last_batch: int, span: int = 72, late: int = 48) -> list[tuple]:
    """(key, start, closed, repeats, conflicts, sum, digest) of batches of (key, hour, digest)."""
    open_, out, most = {}, [], None
    for b, rows in enumerate(batches):
        for key, hour, digest in sorted(r for r in rows if most is None or r[1] >= most - late):
            w = open_.get(key)
            if w and hour <= w[0] + span:
                w[1] += 1
                if digest != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(digest.hex().encode())
            else:
                if w:
                    out.append((key, w[0], b, *w[1:]))
                open_[key] = [hour, 0, 0, 0, digest]
        most = max([r[1] for r in rows] + ([] if most is None else [most]), default=None)
        for key in [k for k, w in open_.items() if most is not None and w[0] + span < most - late]:
            w = open_.pop(key)
            out.append((key, w[0], b, *w[1:]))
    return sorted(out + [(key, w[0], last_batch, *w[1:]) for key, w in open_.items()])


def test_click_query_against_its_contract(spark):
    clicks = pq.read_table(f"{SF}/clicks.parquet").to_pylist()
    copies = []
    for r in clicks:
        for j in range(r["click_id"] % 3 + 1):
            c = zlib.crc32(f"{r['click_id']}:{j}".encode())
            hour = (r["arrived_at"] - EPOCH) // datetime.timedelta(hours=1) + 6 * j * (c % 10)
            value = "" if r["value"] is None else str(math.floor(100 * r["value"] + 0.5))
            ts = "" if r["ts"] is None else str((r["ts"] - EPOCH) // datetime.timedelta(microseconds=1))
            text = "|".join(("" if r["client_id"] is None else str(r["client_id"]), r["kind"] or "", value, ts, r["props"] or "", str(c % 3)))
            copies.append((hour + c // 10 % 200, r["click_id"], hour, hashlib.sha256(text.encode()).digest()))
    least, most = min(copies)[0], max(copies)[0]
    batches = [[] for _ in range(12)]
    for level, *row in copies:
        batches[(level - least) * 12 // (most - least + 1)].append(tuple(row))
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        d = queries.op11_click_dedup(spark, SF, rows_a_group=20)
        got = sorted((r["click_id"], r["start_hour"], r["closed_batch"], r["n_repeats"], r["n_conflicts"], r["conflict_crc"], bytes.fromhex(r["hash"])) for r in d.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == folded(batches, 11)
    assert all(t == "bigint" for n, t in d.dtypes if n != "hash")


def stream_of(spark, tmp_path, batches, **options):
    folders = []
    for k, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, click_dedup.ROWS).write.parquet(f"{tmp_path}/{k}")
            folders.append((k, f"{tmp_path}/{k}"))
    hours = [r[1] for b in batches for r in b if r[1] is not None]
    d = click_dedup.deduplicated(spark, folders, f"{tmp_path}/{uuid.uuid4().hex}", last_hour=max(hours, default=0), last_batch=len(batches) - 1, origin=min(hours, default=0), **options)
    return sorted((*r[:6], bytes(r[6])) for r in d.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_click_windows_of_random_batches(spark, tmp_path, seed):
    """Bounds met exactly, negative hours, an empty batch, late rows, several chunks of a group."""
    r = random.Random(seed)
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(3)]
    batches = [[(r.randrange(9), -100 + 60 * b + 12 * r.randrange(-6, 8), r.choice(digests)) for _ in range(0 if b == 2 else 60)] for b in range(5)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert stream_of(spark, tmp_path, batches, buckets=2) == folded(batches, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_click_rows_without_key_or_hour_and_none_at_all(spark, tmp_path):
    d = b"x" * 32
    assert stream_of(spark, tmp_path / "a", [[(None, 5, d), (1, None, d), (1, 5, d), (1, 5, d)]]) == [(1, 5, 0, 1, 0, 0, d)]
    assert stream_of(spark, tmp_path / "b", [[]]) == []


def test_click_chunks_are_added_up(monkeypatch):
    monkeypatch.setattr(click_dedup, "COMPACT", 10)
    r = np.random.default_rng(3)
    chunks, rows = click_dedup.Chunks(), []
    for _ in range(9):
        f = pd.DataFrame({"key": r.integers(0, 3, 8), "hour": r.integers(0, 4, 8), "digest": [bytes([x]) * 32 for x in r.integers(0, 2, 8)], "n": 1})
        chunks.add(f)
        rows += f[["key", "hour", "digest"]].itertuples(index=False, name=None)
    key, hour, words, n = chunks.sorted()
    raw = words.astype(">u8").tobytes()
    got = [(int(k), int(h), raw[32 * i : 32 * i + 32], int(c)) for i, (k, h, c) in enumerate(zip(key, hour, n, strict=True))]
    assert got == sorted((*x, rows.count(x)) for x in set(rows))


# Runs


def runs_by_hand(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def texts_with_runs(r: random.Random) -> str:
    out = []
    for _ in range(r.randrange(1, 7)):
        if r.random() < 0.5:
            period = [r.choice("a b c".split()) for _ in range(r.randrange(1, 7))]
            out += (period * 12)[: r.randrange(1, 45)]
        else:
            out += [r.choice("a b c d é".split()) for _ in range(r.randrange(20))]
    return r.choice([" ", "\n\t "]).join(out)


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (9, 5)])
def test_runs_by_hand(least, exponent):
    r = random.Random(7)
    texts = [texts_with_runs(r) for _ in range(150)] + ["", " \n", "a", "a a a a a", "a a a a a a", "ab " * 3000, " ".join("xyz"[k % 3] for k in range(999)) + " y"]
    for t, got in zip(texts, periodic_runs.found_in([t.encode() for t in texts], least, exponent), strict=True):
        assert [(a, b - a, q) for a, b, q in got.tolist()] == runs_by_hand(t.split(), least, exponent), t


def test_short_runs_across_large_blocks():
    """Many short segments, so that runs lie across middles of blocks far longer than they are."""
    r = random.Random(11)
    texts = [" ".join(["u"] * r.randrange(6, 9) + [f"w{k}"]) for k in range(400)]
    for t, got in zip(texts, periodic_runs.found_in([t.encode() for t in texts]), strict=True):
        assert got.tolist() == [[0, len(t.split()) - 1, 1]]


def test_run_query_against_its_contract(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h = zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_hand(words)
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert sum(r["n_runs"] for r in got.values()) > 5


def test_runs_of_odd_rows(spark):
    """Nulls, ties, repeated rows, clashing names, a long text, an empty table."""
    long = "x y " * 100_000 + "z"
    rows = [(None, "a " * 8, "c"), (1, None, "c"), (1, None, "c"), (2, "", "c"), (3, long, "c"), (4, "a a a a a a b b b b b b", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.collapse(d).collect()
    assert sorted((r["doc_id"] or -1, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [(-1, [(0, 8, 1)], "a"), (1, [], ""), (1, [], ""), (2, [], ""), (3, [(0, 200_000, 2)], "x y z"), (4, [(0, 6, 1), (6, 6, 1)], "a b")]
    assert periodic_runs.collapse(d.limit(0)).count() == 0


# Token files


def library():
    t = Tokenizer.from_file(token_files.VOCABULARY)
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "it's  we'll'", "é x y", "　日本 語\n語", "x  y z", "<|endoftext|> a", "1 23\t4 5", "a\x1c b \x85c d", "᠎a b᠎ c", "don't won't 'tis", "🙂 🙂\n🙂", "a\r\nb c", "été*** naïve, Über&&& x× y÷z ÿ ȿa ğ.", "word.'s a's, (b) c\"", "ab\\\\ c~~ d-e- f_"]


def test_pieces_give_the_ids_of_whole_texts(spark):
    t, encode = library(), token_files.encoder_of(open(token_files.VOCABULARY).read())
    r = random.Random(5)
    parts = [*ODD, "word", "Zwölf", "…", "\n", "  ", " \n ", "'s", "ab.c", "77"]
    texts = ODD + ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(40))) for _ in range(400)]
    texts += [x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", [" ", "\n", "x", "ab c"])
def test_long_texts_are_encoded_whole(unit):
    encode = token_files.encoder_of(open(token_files.VOCABULARY).read())
    text = unit * (2_000_000 // len(unit)) + "end"
    t = library()
    assert t.decode(np.frombuffer(encode(text), "<u4").tolist()) == text


def test_file_query_against_its_contract(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    t, at, want = library(), 0, []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    d = queries.op13_token_files(spark, SF)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in d.collect()) == want


def test_files_give_sequences_and_masks_without_copies(spark, tmp_path):
    """Equal-length sequences across documents; the last one of a file is filled; rows of a batch are many."""
    words = "alpha beta gamma delta".split()
    rows = [(i % 7 if i % 5 else None, " ".join(words[: i % 4]) if i % 3 else None, i) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id int, text string, ids int").repartition(3)
    path = f"{tmp_path}/files"
    token_files.write(d, path, length=5)
    back = token_files.read(spark, path)
    assert dict(back.dtypes)["doc_id"] == "int"
    got = sorted(back.collect(), key=lambda r: r["start"])
    t = library()
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if a is None else a for a, _, _ in rows)
    texts = {}
    for a, text, _ in rows:
        texts.setdefault(a, []).append([*t.encode(text or "").ids, 2])
    flat = []
    for r in got:
        assert r["start"] == len(flat) and r["n_tokens"] * 4 == len(r["ids"])
        flat += np.frombuffer(r["ids"], "<u4").tolist()
        texts[r["doc_id"]].remove(flat[r["start"] :])
    assert not any(texts.values())
    read = []
    for f in token_files.manifest(path)["files"]:
        file = token_files.SequenceFile(f"{path}/{f['name']}.arrow")
        held = []
        for k in range(len(file)):
            ids, mask = file[k]
            assert len(ids) == len(mask) == 5 and ids.dtype == np.uint16
            assert mask.true_count == 5 or k == len(file) - 1
            held += ids[: mask.true_count].tolist()
            assert not ids[mask.true_count :].any()
        low, high = pa.total_allocated_bytes(), len(file)
        assert file[high - 1][0].base is not None and pa.total_allocated_bytes() == low
        with pytest.raises(IndexError):
            file[high]
        assert len(held) == f["n_tokens"]
        read += held
    assert read == flat


def test_files_of_an_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(d, f"{tmp_path}/none")
    assert token_files.manifest(f"{tmp_path}/none")["files"] == [] and token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_a_hot_id_is_dealt_over_files(spark, tmp_path):
    d = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same text in each").alias("text"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(d, f"{tmp_path}/hot")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    sizes = [f["n_docs"] for f in token_files.manifest(f"{tmp_path}/hot")["files"]]
    assert sum(sizes) == 4000 and max(sizes) < 2000
