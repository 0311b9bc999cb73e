"""Token counts with a whole-token shortcut.

A piece vocabulary with byte fallback is read once.  Two facts are proved from it
before any text is seen:

* which vocabulary strings, encoded alone, come back as one token (they count 1
  without any merge), and
* where a token can never reach across: a word mark stands only at the start of
  pieces, and a "solo" character is in no piece of two or more characters.

Texts are cut at the certain places; a fragment that is a proved string counts 1,
the others are merged by the tokenizer and remembered."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import model_bytes, texts_of, with_arrow

MARK = "▁"
#: Fragments a worker remembers; then it starts anew.
CACHE_ENTRIES = 400_000
_RUNS = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Counts tokens of whole texts as the model's own encoder gives them."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.encode("a a", out_type=str)[0] == MARK + "a"
        solo = "\n" not in "".join(p for p in pieces if len(p) > 1)
        self.base = len(self.sp.encode("\n"))
        #: cost of the line end itself, or None when it may be part of a longer token
        self.line_end = len(self.sp.encode("\n\n")) - self.base if solo and self.marks_lead else None
        self.whole = self.prove(pieces)
        # a lone space stands before a line end; a line end without a word adds nothing
        self.proved = dict.fromkeys(self.whole, 1) | {" ": 1, "\n": 0}
        self.cost: dict[str, int] = dict(self.proved)

    def prove(self, pieces: list[str]) -> set[str]:
        """Word forms " x" whose piece encodes alone as one token."""
        words = [" " + p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        return {w for w, ids in zip(words, self.sp.encode([w[1:] for w in words])) if len(ids) == 1}

    def learn(self, needed: set[str]) -> None:
        """Encode the needed fragments that are not known yet, all in one call."""
        words = [f for f in needed if f not in self.cost]
        if len(self.cost) + len(words) > CACHE_ENTRIES:
            self.cost = dict(self.proved)
            words = [f for f in needed if f not in self.cost]
        found = self.sp.encode([w if w[0] == "\n" else w[1:] for w in words], num_threads=1) if words else []
        for w, ids in zip(words, found):
            self.cost[w] = len(ids) - self.base if w[0] == "\n" else len(ids)

    def fragments(self, text: str) -> tuple[list[str], int]:
        """Pieces of the text between certain cuts, and the tokens of its line ends.

        A fragment begins with a space, or with the line end it follows."""
        if self.line_end is None:
            return self.line_fragments(" " + text), 0
        first, *rest = text.split("\n")
        out = self.line_fragments(" " + first)
        for line in rest:
            if line:
                out.extend(self.line_fragments(line))
        return out, self.line_end * len(rest)

    @staticmethod
    def line_fragments(line: str) -> list[str]:
        head = []
        if line[0] != " ":
            first, mark, line = line.partition(" ")
            head = ["\n" + first]
            if not mark:
                return head
            line = mark + line
        if "  " in line or line[-1] == " ":
            return head + _RUNS.findall(line)
        return head + [" " + w for w in line[1:].split(" ")]

    def count_all(self, texts: list[str]) -> list[int]:
        texts = [t.replace(MARK, " ") for t in texts]
        if not self.marks_lead:
            return [len(self.sp.encode(t)) for t in texts]
        cut = [self.fragments(t) if t else ([], 0) for t in texts]
        self.learn(set().union(*(fragments for fragments, _ in cut)))
        cost = self.cost
        return [ends + sum([cost[f] for f in fragments]) for fragments, ends in cut]


@lru_cache(maxsize=2)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`df` plus the number of tokens of each whole text.

    No begin, end or special tokens.  A null or empty text has 0 tokens; every row,
    repeated or not, gives one row; a column named `out` is replaced.  Row-local:
    no shuffle at any size."""
    model = model_bytes(df.sparkSession, model_path)

    def make():
        counter = _counter(model.value)
        return lambda column: [pa.array(counter.count_all(texts_of(column)), pa.int64())]

    return with_arrow(df, [text], {out: "long"}, make)
