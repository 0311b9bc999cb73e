"""Keep-first, keep-last, numbering and union of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key.  ``max_by`` combines on the map side, so a key that
    fills a third of the table sends one row per map task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def merge_batches(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Columns united, the row of the later batch wins."""
    for side in (old, new):
        lacking = [k for k in keys if k not in side.columns]
        if lacking:
            raise ValueError(f"batch lacks key columns {lacking}")
    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, order)


def number_duplicates(df: DataFrame, label: str, order: str, span: int | None = None) -> DataFrame:
    """Second and later occurrences of a label get ``_2``, ``_3`` ..."""
    from ..skew import running_total

    ranked = running_total(df, [label], order, F.lit(1).cast("long"), "occurrence", **({"span": span} if span else {}))
    return ranked.withColumn(
        "numbered",
        F.when(F.col("occurrence") > 1, F.concat(F.col(label), F.lit("_"), F.col("occurrence").cast("string"))).otherwise(F.col(label)),
    )


def append_new(log: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is not in the log yet (append-only log)."""
    return batch.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def skip_processed(files: DataFrame, done: DataFrame, key: str, suffixes: tuple[str, ...] = ("_anonim", "_ekstrak", "relevant_context")) -> DataFrame:
    stem = F.regexp_replace(F.col(key), r"\.[A-Za-z0-9]+$", "")
    fresh = files
    for s in suffixes:
        fresh = fresh.filter(~stem.contains(s))
    return fresh.join(done.select(key), key, "left_anti")
