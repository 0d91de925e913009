"""Byte-level BPE from a public vocabulary file of ranks (one ``base64 rank`` a line).

The driver reads the file, whose size is fixed, and sends the ranks to the workers.

Texts of any length are encoded whole, but for one rule: the pattern's look-ahead overflows the
library's stack on some hundred thousand white-space characters in a row, so a run of more than
``LONGEST_BLANK`` of them is cut every ``LONGEST_BLANK`` characters, the pieces are encoded one by
one and their ids joined.  Tokens of all other texts stay as they are."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's text is cut before merging; a fixed value of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space in a row that is encoded at once, at most.
LONGEST_BLANK = 65_536
_LONG = re.compile(rf"\s{{{LONGEST_BLANK + 1},}}")


def pieces(text: str) -> list[str]:
    """The text, cut within runs of white space that are too long; what follows a run keeps its last part."""
    if len(text) <= LONGEST_BLANK:
        return [text]
    cuts = [0, *(k for m in _LONG.finditer(text) for k in range(m.start() + LONGEST_BLANK, m.end(), LONGEST_BLANK)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    return [i for piece in pieces(text) for i in encoder.encode_ordinary(piece)]


@lru_cache(maxsize=2)
def encoding_of(data: bytes, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of every token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


class Vocabulary:
    """Travels to the workers as a broadcast; each builds its encoder once."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            data = f.read()
        self.data, self.pattern = spark.sparkContext.broadcast(data), pattern
        self.size = len(encoding_of(data, pattern)[1])

    def __getstate__(self):
        return {"data": self.data, "pattern": self.pattern, "size": self.size}

    def load(self) -> tuple[tiktoken.Encoding, np.ndarray]:
        return encoding_of(self.data.value, self.pattern)
