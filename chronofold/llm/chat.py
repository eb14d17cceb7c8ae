"""Chat formatting with offset-aligned loss masks.

A turn is written as <|im_start|>role<|im_sep|>text<|im_end|> and a line break. Control strings inside roles and texts
are escaped by one backslash between "<" and "|" (and one more where there are some already), which is undone on
reading. A whole conversation is rendered, encoded once with offsets, and the spans of the assistant texts, sorted as
they are, are cut with the spans of the tokens by binary search. The three marks are tokens of their own, so a span
never begins or ends inside a token.

At scale: turns are sorted within partitions by conversation and read as a stream; a task holds one conversation and a
bounded number of encoded ones. Nothing else is shuffled.

Edge cases: a null text or role is empty; turns that tie are ordered by role and text, null turns come first; a null
conversation id is a conversation of its own; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .tokens import public_path

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Signs of formatted text that are encoded at a time.
BATCH_SIGNS = 1 << 20

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the texts that are trained on, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition(SEP)
        turns.append((unescape(role), unescape(rest[: rest.rindex(STOP)])))
    return turns


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """A byte-level tokenizer with the marks as tokens and offsets that leave no sign out."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    found.add_special_tokens([START, SEP, STOP])
    return found


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found = chat_tokenizer(path)
    marks = {START, SEP, STOP}
    vocabulary = sorted(found.get_vocab().items(), key=lambda x: x[1])
    out = [b""] * (vocabulary[-1][1] + 1)
    for token, i in vocabulary:
        out[i] = token.encode() if token in marks or any(c not in signs for c in token) else bytes(signs[c] for c in token)
    return out


def mask(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """1 for every token that lies in a span. offsets: (tokens, 2), in order."""
    found = np.zeros(len(offsets), np.int8)
    starts, ends = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2).T
    first = np.searchsorted(offsets[:, 1], starts, "right")
    last = np.searchsorted(offsets[:, 0], ends, "left")
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        found[a:b] = 1
    return found


FORMATTED = "conv_id long, text string, input_ids array<int>, loss_mask array<tinyint>"
FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    key, turns = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and row[0] != key:
                yield key, turns
                turns = []
            key = row[0]
            turns.append((row[1] or "", row[2] or ""))
    if turns:
        yield key, turns


def _list(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def format_chats(turns: DataFrame, vocabulary: str = "byte_bpe_50k.json", trained: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, text, input_ids, loss_mask. turns: conv_id, turn, role, text."""

    def encoded(held: list) -> pa.RecordBatch:
        found = chat_tokenizer(public_path(vocabulary)).encode_batch([t for _, t, _ in held], add_special_tokens=False)
        ids = [np.array(e.ids, np.int32) for e in found]
        masks = [mask(spans, np.array(e.offsets, np.int64).reshape(-1, 2)) for (_, _, spans), e in zip(held, found, strict=True)]
        columns = [pa.array([k for k, _, _ in held], pa.int64()), pa.array([t for _, t, _ in held]), _list(ids, pa.int32()), _list(masks, pa.int8())]
        return pa.RecordBatch.from_arrays(columns, schema=FORMATTED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, rows in _conversations(batches):
            text, spans = render(rows, trained)
            held.append((key, text, spans))
            size += len(text)
            if size >= BATCH_SIGNS:
                yield encoded(held)
                held, size = [], 0
        if held:
            yield encoded(held)

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = slim.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """What the formatted conversations say: turns from their text, trained texts from ids and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(public_path(vocabulary))
        for batch in batches:
            rows = []
            lists = (c.to_pylist() for c in batch.columns[:2])
            ids_col, mask_col = batch.column(2), batch.column(3)
            for n, (conv, text) in enumerate(zip(*lists, strict=True)):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                ids, on = ids_col[n].values.to_numpy(), mask_col[n].values.to_numpy().astype(bool)
                edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
                loss = "".join(unescape(b"".join(pieces[i] for i in ids[a:b].tolist()).decode()) for a, b in edges.reshape(-1, 2).tolist())
                rows.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = [c.split()[0] for c in DIGEST.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "text", "input_ids", "loss_mask").mapInArrow(run, DIGEST)


def chat_round_trip(turns: DataFrame) -> DataFrame:
    """Formats all conversations, writes them and returns what can be read back, a row for each."""
    return read_back(stored(format_chats(turns), "formatted-chats"))
