"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with character offsets.  The
turns' content spans and the tokens' spans are both sorted, so a binary search
tells which tokens lie in the contents that a loss is taken on.  Marks are special
tokens, so no token reaches across the edge of a content."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import AddedToken, Tokenizer, processors

from .common import model_bytes, with_arrow

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Every control string begins with "<|"; inside texts a backslash goes between the two.
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(roles: list[str], texts: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each turn's escaped text."""
    out, spans, at = [], [], 0
    for role, text in zip(roles, texts):
        head, body = START + escape(role) + MIDDLE, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint spans."""
    spans = [s for s in spans if s[1] > s[0]]
    if not spans:
        return np.zeros(len(starts), bool)
    lo, hi = np.array(spans).T
    at = np.minimum(np.searchsorted(hi, starts, side="right"), len(hi) - 1)
    return (starts < hi[at]) & (ends > lo[at]) & (ends > starts)


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Tokenizer:
    tok = Tokenizer.from_str(data.decode())
    tok.no_truncation()
    tok.no_padding()
    tok.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep leading spaces
    tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, END)])
    return tok


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order of turn.

    A conversation is the unit that is rendered and encoded, so it must fit in a
    task.  Null turns come first, equal turns are ordered by role and text, and
    repeated rows are turns of their own.  Null roles and texts are empty; rows
    with a null conv_id form one conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))


def format_chats(chats: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """`conv_id, roles, texts` to `conv_id, formatted, ids, starts, ends, loss`:
    the rendered text, its tokens with offsets in code points, and for each token
    whether it belongs to a text of one of `loss_roles`.  An empty table gives an
    empty table; a conversation of empty texts has no token under the mask."""
    data = model_bytes(chats.sparkSession, tokenizer_path)

    def make():
        tok = _encoder(data.value)

        def fn(roles, texts):
            formatted, ids, starts, ends, loss = [], [], [], [], []
            for r, t in zip(roles.to_pylist(), texts.to_pylist()):
                text, spans = render(r, t)
                coded = tok.encode(text, add_special_tokens=False)
                offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
                formatted.append(text)
                ids.append(np.array(coded.ids, np.int32))
                starts.append(offsets[:, 0].astype(np.int32))
                ends.append(offsets[:, 1].astype(np.int32))
                loss.append(mask_of([s for s, role in zip(spans, r) if role in loss_roles], offsets[:, 0], offsets[:, 1]))
            whole = pa.list_(pa.int32())
            return [pa.array(formatted, pa.string()), pa.array(ids, whole), pa.array(starts, whole), pa.array(ends, whole), pa.array([x.tolist() for x in loss], pa.list_(pa.bool_()))]

        return fn

    outs = {"formatted": "string", "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "loss": "array<boolean>"}
    return with_arrow(chats, ["roles", "texts"], outs, make, drop=("roles", "texts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted conversations: `roles` and `texts` of all turns as parsed
    from the text, and `loss_texts`, the unescaped text under each unbroken run of
    tokens in the mask."""

    def make():
        def fn(text, starts, ends, loss):
            roles, texts, losses = [], [], []
            for f, s, e, m in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), loss.to_pylist()):
                turns = parse(f)
                roles.append([r for r, _ in turns])
                texts.append([t for _, t in turns])
                on = np.flatnonzero(np.diff(np.concatenate([[0], np.array(m, np.int8), [0]])))
                losses.append([unescape(f[s[a] : max(e[a:b])]) for a, b in zip(on[::2], on[1::2])])
            kind = pa.list_(pa.string())
            return [pa.array(roles, kind), pa.array(texts, kind), pa.array(losses, kind)]

        return fn

    outs = {"roles": "array<string>", "texts": "array<string>", "loss_texts": "array<string>"}
    return with_arrow(formatted, ["formatted", "starts", "ends", "loss"], outs, make, drop=("starts", "ends", "loss", "ids"))
