"""Token ids as Arrow stream files of equal-length sequences with masks.

A file is an Arrow stream of record batches with two fixed-size lists a row: ``ids``, in the
narrowest unsigned type that the vocabulary fits, and ``mask``, true for ids and false for
what fills the file's last sequence.  Nothing is compressed and all batches but the last have
as many rows, so a mapped file gives any sequence without a copy.  Beside each file another
stream lists its documents (id, first place, number of ids); a manifest, written last and by
the driver, names the files in order with how many ids each holds.

Writing: rows are dealt by ranges of (doc_id, hash of the text, a row number), so neither a hot id nor
equal rows pile up in one task; a task sorts its range, encodes and writes one file
under a name of its own attempt, a batch in memory.  Attempts that are lost leave files that
no manifest names.  The files go to a folder that all machines share, by a path or URI that
pyarrow opens.

Texts are encoded by the ``tokenizers`` library, whole.  Between two characters that are no
white space in any version of Unicode, the second after one space or line end, a byte-level
vocabulary never merges; so the library encodes each such piece by itself, and the ids of the
pieces met lately are kept.  Control strings in a text are ordinary text.

Defined results: a null or empty text is the end id alone; texts of any length are encoded
whole; documents of one id go by their text's hash, equal rows stand one after the other;
a null id comes first; an empty table gives a manifest without files; only the named columns
are read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from quarrystone.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END = 2
LENGTH = 2048
#: Sequences of a record batch.
ROWS = 256
#: Pieces whose ids are kept, at most, and how long they may be.
KEPT, SHORT = 700_000, 48
#: Letters in all versions of Unicode: a word of them is one unit of the vocabulary's merges.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Marks that are a unit of their own after letters; not the apostrophe, which may join either.
MARKS = ".,;:!?*$#%&|<>()[]{}\"/\\+-=_~^@`"
#: How byte-level vocabularies write bytes: what prints stands for itself, the others follow from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: What may be white space in some version of Unicode, control characters included.
MAYBE_BLANK = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u206f\\u3000\\ufeff"
CUT = re.compile(f"(?<=[^{MAYBE_BLANK}])(?=[ \\n][^{MAYBE_BLANK}])")
SOLID = re.compile(f"[^{MAYBE_BLANK}](?:.*[^{MAYBE_BLANK}])?", re.DOTALL)
FORMAT = "token_sequences"


class Uncut(Exception):
    """A piece that can't be encoded by itself."""


class Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit numbers, by what stands between two cuts.

    The library's model takes words straight; all else goes the whole way through the library."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        if WORD.fullmatch(piece):
            ids = self.encoder.by_model(self.lead + piece)
        elif (word := piece.rstrip(MARKS)) != piece and WORD.fullmatch(word):
            ids = self[word] + self.encoder.piece(piece[len(word) :])
            if len(piece) > 9:  # the word is kept, and most such pairs come once
                return ids
        elif SOLID.fullmatch(piece):
            ids = self.encoder.by_library(self.lead + piece)
        else:
            raise Uncut
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.first, self.after, self.rest = Pieces(self, ""), Pieces(self, " "), {}
        self.end_of_line = self.by_library("\n")

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_model(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(BYTES))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            first, after, lines = self.first, self.after, []
            for line in text.split("\n"):
                head, *others = line.split(" ")
                lines.append(first[head] + b"".join([after[p] for p in others]))
            return self.end_of_line.join(lines)
        except Uncut:
            return b"".join(map(self.piece, CUT.split(text)))

    def piece(self, piece: str) -> bytes:
        ids = self.rest.get(piece)
        if ids is None:
            ids = self.by_library(piece)
            if len(piece) <= SHORT:
                if len(self.rest) >= KEPT:
                    self.rest.clear()
                self.rest[piece] = ids
        return ids


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(vocabulary)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def schemas(length: int, size: int, kind: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    ids = pa.uint8() if size <= 1 << 8 else pa.uint16() if size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))]), pa.schema([("doc_id", kind), ("first", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """One file of sequences and the list of its documents; a batch is held at a time."""

    def __init__(self, store: fs.FileSystem, path: str, length: int, size: int, kind: pa.DataType):
        self.sequences, self.docs = schemas(length, size, kind)
        self.length, self.n, self.fill = length, 0, 0
        self.type = self.sequences.field("ids").type.value_type
        self.block = np.zeros(ROWS * length, self.type.to_pandas_dtype())
        self.sinks = [store.open_output_stream(f"{path}.arrow", compression=None), store.open_output_stream(f"{path}.docs.arrow", compression=None)]
        self.streams = [pa.ipc.new_stream(s, schema) for s, schema in zip(self.sinks, (self.sequences, self.docs), strict=True)]
        self.listed: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.listed.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        while len(ids):
            some = ids[: len(self.block) - self.fill]
            self.block[self.fill : self.fill + len(some)] = some
            self.fill += len(some)
            ids = ids[len(some) :]
            if self.fill == len(self.block):
                self._flush(self.fill)
        if len(self.listed) >= 4096:
            self._list()

    def _flush(self, fill: int) -> None:
        rows = -(-fill // self.length)
        self.block[fill : rows * self.length] = 0
        mask = pa.array(np.arange(rows * self.length) < fill)
        each = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.block[: rows * self.length], self.type), mask)]
        self.streams[0].write_batch(pa.RecordBatch.from_arrays(each, schema=self.sequences))
        self.fill = 0

    def _list(self) -> None:
        self.streams[1].write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.listed, strict=True), self.docs, strict=True)], schema=self.docs))
        self.listed = []

    def close(self) -> None:
        if self.fill:
            self._flush(self.fill)
        if self.listed:
            self._list()
        for x in (*self.streams, *self.sinks):
            x.close()


class SequenceFile:
    """Sequences of a file by number, without copies where the file can be mapped."""

    def __init__(self, path: str):
        store, at = opened(path)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.batches = list(pa.ipc.open_stream(self.source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self.batches[i // ROWS], i % ROWS
        ids, mask = batch.column("ids"), batch.column("mask")
        n = ids.type.list_size
        return ids.values.slice((ids.offset + row) * n, n).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + row) * n, n)


@dataclass
class Written(WriterCommitMessage):
    place: int
    name: str
    n_tokens: int
    n_docs: int


class TokenSequences(DataSource):
    """Writes (doc_id, text), dealt and sorted before; reads (doc_id, start, n_tokens, ids), where
    ids are little-endian unsigned 32-bit numbers and start counts over all files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"doc_id {manifest(self.options['path'])['doc_id']}, start long, n_tokens long, ids binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.end, self.length = options["path"], int(options["end"]), int(options["length"])
        self.kind = schema["doc_id"].dataType.simpleString()
        with open(options["vocabulary"], encoding="utf-8") as f:
            self.vocabulary = f.read()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        encode, out, n_docs = encoder_of(self.vocabulary), None, 0
        place, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        store, root = opened(self.path)
        end = np.array([self.end], "<u4").tobytes()
        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    out = SequenceWriter(store, f"{root}/{name}", self.length, max(self.end + 1, encode.library.get_vocab_size()), batch.column("doc_id").type)
                out.add(doc_id, np.frombuffer(encode(text.as_py()) + end, "<u4"))
                n_docs += 1
        if out is None:
            return Written(place, "", 0, 0)
        out.close()
        return Written(place, name, out.n, n_docs)

    def commit(self, messages: list[Written]) -> None:
        files = [{"name": m.name, "n_tokens": m.n_tokens, "n_docs": m.n_docs} for m in sorted(messages, key=lambda m: m.place) if m and m.n_docs]
        store, root = opened(self.path)
        with store.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"doc_id": self.kind, "length": self.length, "end": self.end, "files": files}).encode())

    def abort(self, messages: list) -> None:
        """What was written stays without a manifest."""


def manifest(path: str) -> dict:
    store, root = opened(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out, before = [], 0
        for f in manifest(self.path)["files"]:
            out.append(InputPartition((f["name"], before)))
            before += f["n_tokens"]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, before = partition.value
        flat, rest = _flat(f"{self.path}/{name}.arrow"), np.zeros(0, np.uint32)
        store, root = opened(self.path)
        with store.open_input_stream(f"{root}/{name}.docs.arrow") as source:
            for docs in pa.ipc.open_stream(source):
                ids, starts, sizes = docs.column("doc_id"), docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                at, held, some = 0, 0, []
                for i, n in enumerate(sizes.tolist()):
                    parts, need = [], n
                    while need:
                        if not len(rest):
                            rest = next(flat)
                        parts.append(rest[:need])
                        need -= len(parts[-1])
                        rest = rest[len(parts[-1]) :]
                    some.append(b"".join(p.astype("<u4").tobytes() for p in parts))
                    held += n
                    if held > 1 << 20 or i + 1 == len(sizes):
                        yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(starts[at : at + len(some)] + before), pa.array(sizes[at : at + len(some)]), pa.array(some, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        at, held, some = at + len(some), 0, []


def _flat(path: str) -> Iterator[np.ndarray]:
    """A file's ids, batch by batch, without what fills its last sequence."""
    store, at = opened(path)
    with pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at) as source:
        for batch in pa.ipc.open_stream(source):
            ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
            full = mask.true_count
            yield ids[:full]


def write(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH) -> None:
    """Encodes and writes a table in ascending order of its id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenSequences)
    opened(path)[0].create_dir(opened(path)[1], recursive=True)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    d = d.repartitionByRange("doc_id", "__hash", "__row").sortWithinPartitions("doc_id", "__hash").select("doc_id", "text")
    with small_batches(spark):
        d.write.format(FORMAT).options(path=path, vocabulary=vocabulary, end=end, length=length).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, a task for each file."""
    spark.dataSource.register(TokenSequences)
    return spark.read.format(FORMAT).option("path", path).load()
