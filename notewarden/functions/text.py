"""Column expressions on text: normalising, snippets, numbers, names of files.

All of them are built-in Spark expressions, so they stay in the JVM and work on
one row at a time (no shuffle)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Texts and limits that results must equal.
TRUNCATED = " ...[truncated]"
ELLIPSIS = "…"
UNKNOWN = "unknown"
MIN_DOC_CHARS = 20
MIN_SOURCE_CHARS = 50


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column | str) -> Column:
    """Trim all white space, line ends included."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def quote_regex(literal: str) -> str:
    """Escape a literal for use inside a Java (or RE2) pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", literal)


def normalize(text: Column | str) -> Column:
    """CRLF/CR to LF, no-break space to space, runs of space/tab to one space."""
    t = col(text)
    lines = F.translate(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\r ", "\n ")
    # most texts are normal already, which one look tells
    return F.when(t.rlike("[ \t\r ](?:(?<! )| )"), F.regexp_replace(lines, "[ \t]+", " ")).otherwise(t)


def squeeze_blank_lines(text: Column | str, keep: int = 2) -> Column:
    return F.regexp_replace(col(text), "\n{%d,}" % (keep + 1), "\n" * keep)


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def clean_snippet(text: Column | str, max_len: int = 500) -> Column:
    t = collapse_space(text)
    return F.when(F.length(t) > max_len, F.concat(F.substring(t, 1, max_len), F.lit(TRUNCATED))).otherwise(t)


def char_context(text: Column | str, start: Column, end: Column, radius: int = 100, max_len: int = 450) -> Column:
    """Snippet of +-radius characters; start/end are 0-based, end exclusive."""
    t = col(text)
    a = F.greatest(start - radius, F.lit(0))
    b = F.least(end + radius, F.length(t))
    return clean_snippet(F.substring(t, a + 1, b - a), max_len)


def leak_context(text: Column | str, start: Column, end: Column, radius: int = 40) -> Column:
    """One-line context with an ellipsis only on the sides that were cut."""
    t = col(text)
    a = F.greatest(start - radius, F.lit(0))
    b = F.least(end + radius, F.length(t))
    body = F.trim(F.regexp_replace(F.replace(F.substring(t, a + 1, b - a), F.lit("\n"), F.lit(" ")), r"\s{2,}", " "))
    return F.concat(
        F.when(a > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")),
        body,
        F.when(b < F.length(t), F.lit(ELLIPSIS)).otherwise(F.lit("")),
    )


def match_spans(text: Column | str, pattern: str) -> Column:
    """ARRAY<STRUCT<start, hit>> of every match, 0-based start, in text order.

    The pieces between matches come from ``split`` and the matches from
    ``regexp_extract_all``; a running length gives the offset of each match."""
    t = col(text)
    hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    pieces = F.split(t, pattern, -1)
    empty = F.array().cast("array<struct<start:int,hit:string>>")
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"]) + F.length(x["hit"])).alias("at"),
            F.concat(
                acc["spans"],
                F.array(F.struct((acc["at"] + F.length(x["piece"])).alias("start"), x["hit"].alias("hit"))),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(F.size(hits) > 0, walked).otherwise(empty)


def replace_each(text: Column | str, pattern: str, label) -> Column:
    """Replace every match by ``label(match)`` - the replacement may depend on
    the match.  Exact per position: text pieces and labels are interleaved."""
    t = col(text)
    hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    joined = F.array_join(
        F.zip_with(
            F.split(t, pattern, -1),
            hits,
            lambda piece, hit: F.concat(piece, F.coalesce(label(hit), F.lit(""))),
        ),
        "",
    )
    return F.when(F.size(hits) > 0, joined).otherwise(t)


def first_number(value: Column | str) -> Column:
    """First integer or decimal after comma-to-dot; 'unknown' when none."""
    found = F.regexp_extract(F.replace(col(value), F.lit(","), F.lit(".")), r"\d+(?:\.\d+)?", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(UNKNOWN))


def missing_to_null(value: Column | str) -> Column:
    return F.nullif(F.nullif(col(value), F.lit(UNKNOWN)), F.lit(""))


def nonspace_length(text: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", ""))


def long_enough(text: Column | str, min_chars: int = MIN_DOC_CHARS) -> Column:
    """Files with fewer trimmed characters are skipped."""
    return F.length(F.regexp_replace(col(text), r"^\s+|\s+$", "")) >= min_chars


def clean_line(text: Column | str) -> Column:
    return collapse_space(F.replace(col(text), F.lit("\x00"), F.lit(" ")))


def clean_value(text: Column | str) -> Column:
    """Trim blanks and ``: , -`` left over from a label, collapse white space."""
    return F.regexp_replace(F.regexp_replace(col(text), "^[ \t:,-]+|[ \t:,-]+$", ""), r"\s+", " ")


def safe_name(text: Column | str, default: str = "pasien") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(col(text), r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def safe_path(text: Column | str, default: str = "pasien") -> Column:
    parts = F.filter(F.split(col(text), r"[\\/]+"), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) == 0, F.lit(default)).otherwise(
        F.array_join(F.transform(parts, lambda p: safe_name(p, default)), "/")
    )


def any_contains(text: Column, terms, singly: int = 3) -> Column:
    """True when the text holds one of the literal terms.  Up to ``singly`` terms are
    searched one by one: far cheaper for each character than an alternation, but the
    text must be cheap to name again, as a column is."""
    terms = list(terms)
    if len(terms) <= singly:
        return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))
    return text.rlike("|".join(quote_regex(t) for t in terms))


def decode_bytes(content: Column | str) -> Column:
    """UTF-8 when valid, else Latin-1; a byte-order mark is dropped."""
    raw = col(content)
    text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def choose_text(candidates: list[tuple[str, Column]], failed: str = "pdf_empty_or_failed") -> Column:
    """First candidate with at least 50 non-space characters, with its status.
    When none qualifies the last candidate's text is kept."""
    status, text = F.lit(failed), F.coalesce(candidates[-1][1], F.lit(""))
    for name, value in reversed(candidates):
        ok = nonspace_length(value) >= MIN_SOURCE_CHARS
        status = F.when(ok, F.lit(name)).otherwise(status)
        text = F.when(ok, value).otherwise(text)
    return F.struct(text.alias("text"), status.alias("extraction_status"))


# Month names by their first three letters (Indonesian and English).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "mei": 5, "may": 5, "jun": 6, "jul": 7,
    "agu": 8, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "des": 12, "dec": 12,
}
MONTH_WORD = (
    "(?:jan(?:uar[iy])?|feb(?:ruar[iy])?|mar(?:et|ch)?|apr(?:il)?|mei|may|jun[ie]?|jul[iy]?"
    "|agu(?:stus)?|aug(?:ust)?|sep(?:tember)?|okt(?:ober)?|oct(?:ober)?|nov(?:ember)?|des(?:ember)?|dec(?:ember)?)"
)
NAMED_DATE = r"(?i)(\d{1,2})\s+(" + MONTH_WORD + r")\s+(\d{4})"
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
NUMERIC_DATE = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(table, F.lower(F.substring(name, 1, 3)))


def parse_date_text(value: Column | str) -> Column:
    """ISO text of a day written as '6 Mei 2026' or '2026-05-06', else NULL."""
    v = col(value)
    day, month, year = (F.regexp_extract(v, NAMED_DATE, i) for i in (1, 2, 3))
    named = F.when(
        day != "", F.concat_ws("-", year, F.lpad(month_number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    )
    return F.coalesce(named, F.nullif(F.regexp_extract(v, ISO_DATE, 1), F.lit("")))


def parse_day_first_date(value: Column | str) -> Column:
    """DATE of '06-05-2026', '6/5/2026' or '6 Mei 2026'; NULL when not a day."""
    v = col(value)
    d, m, y = (F.regexp_extract(v, "^" + NUMERIC_DATE, i) for i in (1, 2, 3))
    numeric = F.try_to_date(F.when(d != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")
    return F.coalesce(numeric, F.try_to_date(parse_date_text(v), "yyyy-MM-dd"))
