"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``[INST]role[/INST]text</s>`` per turn, encoded
once with character offsets, and its token spans are intersected with the sorted
spans of the assistant's texts by binary search. The control strings are special
tokens of the encoder, so no token crosses the border of a turn. Control strings
inside a role or text get one backslash more after their first character
(``[\\INST]``), and ``unescape`` takes it away again, whatever the text holds.

Turns go by ``turn`` (nulls first), then role and text; null roles and texts are
empty; repeated rows are turns of their own; rows with a null ``conv_id`` are one
conversation. Turns reach a task sorted and stream through it, so one
conversation at a time is in memory. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, CLOSE, END, "<|endoftext|>")
LOSS_ROLE = "assistant"
_ESCAPE = re.compile("(?:" + "|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROL) + ")")
_UNESCAPE = re.compile("(?:" + "|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL) + ")")
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(CLOSE)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss-bearing texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        parts += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def encoder(tokenizer_file: str):
    """The tokenizer with the control strings as special tokens and untrimmed offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(tokenizer_file)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    tok.add_special_tokens([OPEN, CLOSE, END])
    return tok


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that overlap a span; spans are sorted and disjoint."""
    if not spans:
        return np.zeros(len(starts), bool)
    lo, hi = (np.array([s[k] for s in spans if s[1] > s[0]] or [0]) for k in (0, 1))
    k = np.clip(np.searchsorted(hi, starts, side="right"), 0, len(hi) - 1)  # first span that ends after the token starts
    return (starts < hi[k]) & (ends > lo[k]) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, read back by the tokens' offsets; each stretch unescaped."""
    lo, hi = starts[loss], ends[loss]
    if not len(lo):
        return ""
    new = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]])
    last = np.r_[new[1:], len(lo)] - 1
    top = np.maximum.accumulate(hi)
    return "".join(unescape(formatted[a:b]) for a, b in zip(lo[new], top[last]))


SCHEMA = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string())]
    + [(k, pa.list_(pa.int32())) for k in ("ids", "starts", "ends")]
    + [("loss", pa.list_(pa.bool_()))]
)


def format_conversations(conversations: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per conversation: its text, token ids, their character offsets and loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_file)
        out: list[tuple] = []

        def close(conv_id, turns):
            formatted, spans = render(turns)
            e = tok.encode(formatted, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            out.append((conv_id, len(turns), formatted, np.array(e.ids, np.int32), at[:, 0], at[:, 1], loss_mask(at[:, 0], at[:, 1], spans)))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out.clear()
            return batch

        current, turns = None, []
        for b in batches:
            for conv_id, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if turns and conv_id != current:
                    close(current, turns)
                    turns = []
                    if len(out) >= 256:
                        yield flush()
                current = conv_id
                turns.append((role or "", text or ""))
        if turns:
            close(current, turns)
        if out:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)
