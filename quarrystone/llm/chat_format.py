"""Chat formatting by token-level assembly.

A turn is rendered as ``### role: text</turn>`` and a line end.  Its role and its
text are encoded each for itself and reserved ids beyond the vocabulary are spliced
in for the three control strings, so no text can forge them.  Within role and text
the control strings are escaped all the same, so that the rendered characters parse
as well: a run of n backslashes before a control string (or the end) becomes 2n, and
one more is put before the control string.  The loss mask is the running sum of marks
at the bounds of what the assistant says; a turn's place in its conversation the
running sum of token counts.

Defined results: a null role or text is empty; turns with equal numbers are ordered
by role and text in digests, by tokens in a conversation's places; repeated rows are
turns of their own; a null conv_id or turn is a value like any other and sorts first;
ids may be of any type; texts of any length are formatted whole; only the named columns
of the input are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.tokenizer import Vocabulary, encode

OPEN, ROLE_END, CLOSE, LINE = "### ", ": ", "</turn>", "\n"
_ESCAPE = {role: re.compile(r"(\\*)(" + "|".join(map(re.escape, marks)) + r"|\Z)") for role, marks in ((True, (OPEN, ROLE_END, CLOSE)), (False, (OPEN, CLOSE)))}
_UNESCAPE = {role: re.compile(r"(\\+)(" + "|".join(map(re.escape, marks)) + r"|\Z)") for role, marks in ((True, (OPEN, ROLE_END, CLOSE)), (False, (OPEN, CLOSE)))}


def escape(text: str, role: bool = False) -> str:
    return _ESCAPE[role].sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str, role: bool = False) -> str:
    return _UNESCAPE[role].sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(role: str, text: str) -> str:
    return OPEN + escape(role, True) + ROLE_END + escape(text) + CLOSE + LINE


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of rendered characters."""
    out, at = [], 0
    mark = re.compile(r"(\\*)(" + "|".join(map(re.escape, (OPEN, ROLE_END, CLOSE))) + ")")
    while at < len(rendered):
        parts, begin, want = [], at + len(OPEN), [ROLE_END, CLOSE]
        pos = begin
        while want:
            m = mark.search(rendered, pos)
            if m is None:
                raise ValueError("a turn is not closed")
            pos = m.end() if m[2] == want[0] or m[2] in (OPEN, CLOSE) else m.start(2) + 1
            if m[2] == want[0] and len(m[1]) % 2 == 0:
                parts.append(rendered[begin : m.start(2)])
                begin = m.end()
                want.pop(0)
        out.append((unescape(parts[0], True), unescape(parts[1])))
        at = begin + len(LINE)
    return out


def assemble(roles: list[str], texts: list[str], encoded, first_id: int, speaker: str = "assistant") -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and loss mask of every turn; reserved ids are first_id (open), +1, +2 (close)."""
    ids, masks = [], []
    for role, said, tokens in zip(roles, encoded([escape(r, True) for r in roles]), encoded([escape(t) for t in texts]), strict=True):
        turn = np.concatenate([[first_id], said, [first_id + 1], tokens, [first_id + 2]]).astype(np.int32)
        mark = np.zeros(len(turn) + 1, np.int8)
        if role == speaker:
            mark[len(said) + 2] += 1
            mark[len(said) + 2 + len(tokens)] -= 1
        ids.append(turn)
        masks.append(np.cumsum(mark)[:-1].astype(np.int8))
    return ids, masks


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def format_turns(turns: DataFrame, vocabulary: Vocabulary, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", speaker: str = "assistant") -> DataFrame:
    """conv_id, turn, tokens, loss_mask, n_tokens, n_chars of every turn: no shuffle."""
    d = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = vocabulary.load()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
                ids, masks = assemble(roles, texts, lambda x: [encode(encoder, t) for t in x], vocabulary.size, speaker)
                chars = [len(render(r, t)) for r, t in zip(roles, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), _lists(ids, pa.int32()), _lists(masks, pa.int8()), pa.array([len(x) for x in ids], pa.int64()), pa.array(chars, pa.int64())], ["conv_id", "turn", "tokens", "loss_mask", "n_tokens", "n_chars"])

    return d.mapInArrow(formatted, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, tokens array<int>, loss_mask array<tinyint>, n_tokens long, n_chars long")


def in_order(formatted: DataFrame) -> DataFrame:
    """Adds start, a turn's first token in its conversation, by a running sum."""
    w = Window.partitionBy("conv_id").orderBy("turn", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    return formatted.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_turn(tokens: np.ndarray, mask: np.ndarray, encoder, first_id: int) -> tuple[str, str, str, int]:
    """Role, text, what the mask covers, and how many characters the turn shows, read back from
    its ids: they are put into characters, control strings for reserved ids, and parsed."""
    marks = {first_id: OPEN, first_id + 1: ROLE_END, first_id + 2: CLOSE + LINE}
    cuts = np.flatnonzero(tokens >= first_id)
    shown, at = [], 0
    for cut in cuts.tolist():
        shown += [encoder.decode_bytes(tokens[at:cut].tolist()).decode(), marks[int(tokens[cut])]]
        at = cut + 1
    whole = "".join(shown)
    ((role, text),) = parse(whole)
    return role, text, unescape(encoder.decode_bytes(tokens[mask.astype(bool)].tolist()).decode()), len(whole)


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conv_id, turn, role, text, loss (null outside the mask), n_chars, n_tokens of every turn,
    read back from its tokens: no shuffle."""
    d = formatted.select("conv_id", "turn", "tokens", "loss_mask", "n_tokens")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = vocabulary.load()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tokens, masks = batch.column("tokens"), batch.column("loss_mask")
                turns = [read_turn(np.asarray(tokens[k].values), np.asarray(masks[k].values), encoder, vocabulary.size) for k in range(batch.num_rows)]
                roles, texts, losses, chars = zip(*turns, strict=True) if turns else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([x or None for x in losses], pa.string()), pa.array(chars, pa.int64()), batch.column("n_tokens")], ["conv_id", "turn", "role", "text", "loss", "n_chars", "n_tokens"])

    return d.mapInArrow(read, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, loss string, n_chars long, n_tokens long")


def digests(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per conversation, read back from the tokens turn by turn.  A digest needs a
    conversation's turns in a row: what was read back streams past, sorted with spills, and
    only hash states are kept; all else is done per turn before."""
    turns = read_back(formatted, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    counts = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, of = None, None, None

        def rows(done: list) -> pa.RecordBatch:
            values = [[k, h[0], h[1].hexdigest(), h[2], h[3].hexdigest(), h[4], h[5]] for k, h in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), [of, *counts], strict=True)], names)

        for batch in batches:
            done, of = [], batch.column("conv_id").type
            for conv, role, text, loss, chars, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "n_chars", "n_tokens")), strict=True):
                if held is None or conv != key:
                    if held is not None:
                        done.append((key, held))
                    held, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], conv
                loss = loss or ""
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode())
                held[2] += len(loss)
                held[3].update(loss.encode())
                held[4] += chars
                held[5] += n
            if done:
                yield rows(done)
        if held is not None:
            yield rows([(key, held)])

    return turns.mapInArrow(digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
