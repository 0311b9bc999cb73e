"""Steps whose failures stay with their row: a document that cannot be read becomes an
error row instead of ending the run.

A step is an expression that is NULL where it fails (``try_*`` functions, permissive
reads, ``is_valid_utf8``), so that good and failed rows part in one pass without a
second read, and nothing is raised inside a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

ERROR = "error"


@dataclass(frozen=True)
class Step:
    """Column ``out`` computed by ``value(columns so far)``; NULL means failed, unless
    ``optional`` says that the row had nothing to compute.  ``reason`` goes to the row."""

    out: str
    value: Callable[[], Column]
    reason: str
    optional: Callable[[], Column] | None = None


def strict_text(content: Column | str) -> Column:
    """Bytes as UTF-8 without a byte-order mark; NULL where they are not UTF-8."""
    raw = T.col(content)
    return F.regexp_replace(F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")), "^﻿", "")


def strict_json(text: Column | str, schema: str) -> Column:
    """An object of the schema; NULL where the text is not one or a field does not fit."""
    t = T.col(text)
    broken = "__broken"
    parsed = F.from_json(t, f"{schema}, {broken} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    return T.let(parsed, lambda p: F.when(p.isNotNull() & p[broken].isNull(), p))


def run_steps(df: DataFrame, steps: list[Step], error: str = ERROR) -> DataFrame:
    """``df`` with each step's column and ``error``: the reason of the first step that
    failed, else NULL.  Steps after a failure are not evaluated for that row."""
    done = df.withColumn(error, F.lit(None).cast("string"))
    for s in steps:
        value = F.when(F.col(error).isNull(), s.value())
        done = done.withColumn(s.out, value)
        failed = F.col(error).isNull() & F.col(s.out).isNull()
        if s.optional is not None:
            failed &= ~F.coalesce(s.optional(), F.lit(False))
        done = done.withColumn(error, F.when(failed, F.lit(s.reason)).otherwise(F.col(error)))
    return done


def result_rows(df: DataFrame, source: str = "source_file", chars_in: Column | None = None, text: str = "text", counts: str = "counts", error: str = ERROR) -> DataFrame:
    """One audit row per input row.  A failed one has the status ``error``, no output,
    no counts, and is to be reviewed by hand."""
    failed = F.col(error).isNotNull()
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    leftovers = F.col("leftovers") if "leftovers" in df.columns else none
    good = F.col(counts).cast("map<string,bigint>")
    review = failed | F.coalesce(F.exists(F.map_values(leftovers.cast("map<string,bigint>")), lambda n: n > 0), F.lit(False))
    size = F.coalesce((F.length(text) if chars_in is None else chars_in).cast("long"), F.lit(0))
    return df.select(
        source,
        F.when(failed, "").otherwise(F.concat(F.regexp_replace(source, r"\.[^./]+$", ""), F.lit(".anon.txt"))).alias("output_file"),
        F.when(failed, ERROR).otherwise("text").alias("extraction_status"),
        F.coalesce(F.col(error), F.lit("")).alias("error"),
        F.when(failed, F.lit(0)).otherwise(size).cast("long").alias("chars_in"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars_out"),
        review.alias("needs_manual_review"),
        F.when(failed, none).otherwise(F.coalesce(good, none)).alias("counts"),
        F.when(failed, none).otherwise(F.coalesce(leftovers.cast("map<string,bigint>"), none)).alias("leftovers"),
    )
