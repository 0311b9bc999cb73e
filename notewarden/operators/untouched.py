"""Text that no rule of a chain can change is left out of the chain.

The rules are loosened into triggers, patterns that are found in every match of the
rule, which RE2 seeks all together in one pass over a batch of texts.  A text without
a trigger is as the chain would leave it.  In another one the chain needs the text
from some lines above the first trigger; what lies above is put back afterwards."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..rules import Rule
from .names import SEPARATOR

#: Counts of repetition up to this stay in a trigger; longer ones only make it slow.
MAX_COUNT = 20
#: Letters and digits that a rule's own words put into one line at most.
OWN_WORDS = 25


def trigger(rule: Rule) -> str:
    """A pattern for RE2 that is found in every match of the rule.

    Looser than the rule wherever the dialects differ: a word boundary stays only
    before an ASCII letter, white space has the vertical tab, long counts have no
    end, look-around and references are left out."""
    p, flags = (rule.gate, "i") if rule.gate else (rule.pattern, rule.flags)
    p = re.sub(r"\(\?<?[=!](?:[^()]|\([^()]*\))*\)", "", p)
    p = re.sub(r"\\[1-9]", "", p)
    head = r"\b" if re.match(r"\\b(?:\(\?:)?[A-Za-z]", p) else ""
    p = head + p.replace(r"\b", "")
    p = re.sub(r"\{(\d+)(,?)(\d*)\}", lambda m: m[0] if int(m[1]) <= MAX_COUNT and not m[2] else "*" if m[1] == "0" else "+", p)
    parts, inside, i = [], False, 0
    while i < len(p):
        part = p[i : i + 2] if p[i] == "\\" else p[i]
        i += len(part)
        if part == r"\s":
            part = r"\s\x0b" if inside else r"[\s\x0b]"
        elif part in "[]":
            inside = part == "["
        parts.append(part)
    return f"(?{''.join(f for f in flags if f in 'ims')}:{''.join(parts)})"


def any_trigger(rules: Iterable[Rule]) -> str:
    return "|".join(dict.fromkeys(trigger(r) for r in rules))


def touched(text: Column, rules: Iterable[Rule]) -> Column:
    """Whether any of the rules may match; a text for which this is false stays as it
    is under a chain of them, in whatever order and however often."""
    pattern = any_trigger(rules)

    def found(texts):
        # self-contained: workers need nothing of this package
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pc.is_valid(texts)
        return pc.match_substring_regex(texts, pattern).fill_null(False)

    return F.arrow_udf(found, "boolean")(text)


def lines_above(rules: Iterable[Rule]) -> int:
    """Full lines (of more than ``OWN_WORDS`` letters and digits) above the first
    trigger that the chain may come to change.

    A match that begins above a trigger, or above an earlier change, takes in the lines
    between.  Full ones it takes in by a long counted run (a name, an address), one for
    each, by a repeated group, or by the words of a name that is sought; and each rule can
    begin above the change of the rule before it."""

    def full(p: str) -> int:
        counted = re.findall(r"(\)?)\{\d+,(\d+)\}", p)
        return sum(int(n) if group else int(n) > OWN_WORDS for group, n in counted) + p.count(SEPARATOR)

    return 2 + sum(full(r.pattern) for r in rules)


def parted(text: Column, rules: list[Rule], lines: Column) -> Column:
    """STRUCT<above, rest>: ``rest`` is the text that the rules may change, from the
    start of a line ``lines`` full lines above the first trigger; '' without a trigger."""
    pattern = any_trigger(rules)
    full = rb"(?:[^0-9A-Za-z]*[0-9A-Za-z]){%d}" % (OWN_WORDS + 1)

    def part(texts, lines):
        # self-contained: workers need nothing of this package
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            texts.validate(full=True)
            places = np.asarray(pc.find_substring_regex(texts, pattern).fill_null(-1))
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            places = np.zeros(len(texts), np.int64)
        above, rest = [], []
        for text, place, n in zip(texts, places.tolist(), lines.to_pylist()):
            whole = text.as_buffer().to_pybytes() if text.is_valid else None
            if place < 0:
                above.append(whole)
                rest.append(None if whole is None else b"")
                continue
            here, seen = whole.rfind(b"\n", 0, place) + 1, 0
            while here and seen < n:
                start = whole.rfind(b"\n", 0, here - 1) + 1
                seen += re.match(full, whole[start:here]) is not None
                here = start
            above.append(whole[:here])
            rest.append(whole[here:])
        columns = [pa.array(c, pa.binary()).view(pa.string()) for c in (above, rest)]
        return pa.StructArray.from_arrays(columns, ["above", "rest"])

    return F.arrow_udf(part, "above string, rest string")(text, lines)
